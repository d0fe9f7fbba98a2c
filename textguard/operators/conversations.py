"""One mapping scope per conversation (M6 across rows): equal values share one placeholder in
every turn of a conversation, numbered per type by first appearance (turn, offset).

Plan: per-turn detection and policy (``anonymize``, narrow) -> explode entities -> first
appearance per (conversation, type, value) (partial/final aggregate) -> ``row_number`` per
(conversation, type) -> join the numbers back to the entity rows -> per-turn replacement
lists (bounded by the per-row entity cap) -> join to the turns and rebuild the text. The
mapping comes out in long form, one row per (conversation, placeholder): no conversation
is ever collected into one row.
"""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions import hashing
from textguard.functions import sqltext as S
from textguard.operators.masking import Anonymized, anonymize

BLOCK_TURNS = 64


def anonymize_conversations(turns: DataFrame, text_col: str = "text", *, scope_cols: Sequence[str] = ("conv_id",),
                            order_col: str = "turn", run_token: str | None = None, **kwargs) -> Anonymized:
    """Placeholder masking with conversation-wide numbering.

    Returns (masked turns with ``anonymized_text``, ``pii_count``, ``session_id``, ``error``;
    long-form mapping ``scope..., session_id, placeholder, value, first_turn``).
    """
    scope = list(scope_cols)
    run_token = run_token or secrets.token_hex(16)
    kwargs.pop("strategy", None)
    a = anonymize(turns, text_col, key_cols=[*scope, order_col], keep_entities=True, strategy="placeholder",
                  run_token=run_token, reuse=True, **kwargs)
    m = hashing.with_token(a.masked, run_token)
    ents = a.masked.filter(F.col("error").isNull()).select(*scope, order_col, F.explode("entities").alias("e")).select(
        *scope, order_col, F.col("e.etype").alias("etype"), F.col("e.value").alias("value"),
        F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    first = ents.groupBy(*scope, "etype", "value").agg(
        F.min(F.struct(F.col(order_col).alias("o"), F.col("start").alias("s"))).alias("first"))
    # Numbered in two steps, so that a hot conversation is no single window: ranks within blocks of turns, then
    # the values that earlier blocks have brought.
    first = first.withColumn("block", F.floor(F.col("first.o") / BLOCK_TURNS))
    earlier = Window.partitionBy(*scope, "etype").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = first.groupBy(*scope, "etype", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*scope, "etype", "block").orderBy("first")) - 1
    numbered = first.withColumn("inside", inside).join(before, [*scope, "etype", "block"]).withColumn("placeholder", F.concat(
        F.lit("<"), F.col("etype"), F.lit("_"), (F.col("inside") + F.col("before")).cast("string"), F.lit(">")))
    reps = (ents.join(numbered.select(*scope, "etype", "value", "placeholder"), [*scope, "etype", "value"])
            .groupBy(*scope, order_col)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("start"), F.col("end").alias("end"),
                                                     F.col("placeholder").alias("placeholder")))).alias("_tg_reps")))
    j = m.join(reps, [*scope, order_col], "left")
    t, r = S.q(text_col), "_tg_reps"
    prev_end = f"IF(i = 0, 0, {r}[i - 1].`end`)"
    rebuilt = F.expr(
        f"concat(array_join(transform({r}, (s, i) -> concat(substring({t}, {prev_end} + 1, s.`start` - {prev_end}), "
        f"s.`placeholder`)), ''), substring({t}, coalesce(try_element_at({r}, -1).`end`, 0) + 1))")
    sid = hashing.session_id(*[F.col(c) for c in scope])
    masked = j.select(
        *[F.col(c) for c in m.columns if c not in ("anonymized_text", "session_id", "strategy", "entities", "_tg_token")],
        F.when(F.col("error").isNull(), F.when(F.col(r).isNull(), F.col(text_col)).otherwise(rebuilt)).alias("anonymized_text"),
        F.when(F.col("error").isNull() & F.col(r).isNotNull(), sid).alias("session_id"),
    )
    mapping = hashing.with_token(numbered, run_token).select(*scope, sid.alias("session_id"), "placeholder", "value",
                              F.col("first.o").alias("first_turn"))
    return Anonymized(masked, mapping, a.shared)

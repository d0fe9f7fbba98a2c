"""Span finding and overlap resolution, entirely in Spark SQL functions.

Spark has no find-all-with-offsets. Two scans with the same Java regex give it:
``regexp_extract_all(text, p, 0)`` returns the matches and ``split(text, p, -1)`` the
text between them, in the same order. A left fold over (gap, match) pairs yields
code-point offsets equal to Python ``finditer`` offsets (``char_length`` and
``substring`` count code points, as Python does).

A span is ``struct<etype, value, start, end, ord>`` with ``end`` exclusive and ``ord``
the detection order used to break ties. All arrays stay inside the row: detection is
a narrow transformation, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions import sqltext as S
from textguard.functions.patterns import MAX_ENTITIES, Recognizer

SPAN_TYPE = T.StructType([
    T.StructField("etype", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("ord", T.IntegerType()),
])
SPANS_TYPE = T.ArrayType(SPAN_TYPE)
STRINGS_TYPE = T.ArrayType(T.StringType())


def empty_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def span(etype, value, start, end, ord_) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(etype).cast("string").alias("etype"),
        as_col(value).cast("string").alias("value"),
        as_col(start).cast("int").alias("start"),
        as_col(end).cast("int").alias("end"),
        as_col(ord_).cast("int").alias("ord"),
    )


def quote_literal(term: str) -> str:
    """Java regex quoting of a literal (same rule as Pattern.quote)."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def add_resolved(df: DataFrame, spans: Column | str, out_col: str, tmp: str = "_tg_bystart") -> DataFrame:
    """D3: longest, then leftmost, then detection order wins; output left to right.

    The spans are sorted by start into a column first; rows whose spans do not overlap at
    all (the common case) then skip the quadratic greedy pass - one linear check over the
    sorted array gives the same answer.
    """
    src = F.expr(spans) if isinstance(spans, str) else spans
    df = df.withColumn(tmp, src)
    df = df.withColumn(tmp, F.expr(S.sort_by_start(S.q(tmp))))
    t = S.q(tmp)
    return df.withColumn(out_col, F.expr(f"IF({S.no_overlaps(t)}, {t}, {S.greedy(t)})")).drop(tmp)


def find_spans(
    df: DataFrame,
    text_col: str,
    recognizers: Sequence[tuple[Recognizer, int]],
    out_col: str,
    count_col: str,
    cap: int = MAX_ENTITIES,
    prefix: str = "_tgf",
    iban_backoff: bool = False,
) -> DataFrame:
    """Add ``out_col`` (raw spans of all recognisers, after their checks) and ``count_col``.

    ``iban_backoff`` (opt-in, not in the original rules): an IBAN candidate that fails its
    checks is retried cut to its country's length when the cut ends at a token boundary.

    ``out_col`` is null when the raw count exceeds ``cap``: offsets are then never
    computed, which bounds the per-row work. Separate projections keep each regex
    evaluated once per row (Catalyst does not merge projections that would duplicate a
    non-trivial expression).
    """
    text = F.col(text_col)
    base = df.columns
    stage1 = []
    for i, (rec, _) in enumerate(recognizers):
        v = F.regexp_extract_all(text, F.lit(rec.pattern), 0)
        if rec.gate:
            v = F.when(F.instr(text, rec.gate) > 0, v).otherwise(F.array().cast(STRINGS_TYPE))
        stage1.append(v.alias(f"{prefix}_v{i}"))
    df = df.select("*", *stage1)

    stage2, counts = [], []
    for i, (rec, _) in enumerate(recognizers):
        v = S.q(f"{prefix}_v{i}")
        stage2.append(F.when(F.col(f"{prefix}_v{i}").isNotNull() & (F.size(F.col(f"{prefix}_v{i}")) > 0),
                             F.split(text, rec.pattern, -1)).alias(f"{prefix}_g{i}"))
        chk = S.check(rec.check, "cv")
        if chk is not None and iban_backoff and rec.check == "iban":
            chk = f"({chk} OR {S.iban_backoff_ok('cv')})"
        counts.append(f"coalesce(size({v}), 0)" if chk is None else f"coalesce(size(filter({v}, cv -> {chk})), 0)")
    total = F.expr(" + ".join(counts) if counts else "0").alias(count_col)
    df = df.select("*", *stage2, total)

    stage3 = [F.expr(S.steps(S.q(f"{prefix}_v{i}"), S.q(f"{prefix}_g{i}"))).alias(f"{prefix}_s{i}")
              for i in range(len(recognizers))]
    df = df.select("*", *stage3)

    parts = []
    for i, (rec, ord_) in enumerate(recognizers):
        v = S.q(f"{prefix}_v{i}")
        sp = S.spans_from(v, S.q(f"{prefix}_s{i}"), rec.etype, ord_)
        chk = S.check(rec.check, "cs.`value`")
        if chk is not None and iban_backoff and rec.check == "iban":
            cut = S.iban_cut("cs.`value`")
            retry = (f"IF({S.iban_backoff_ok('cs.`value`')}, named_struct('etype', cs.`etype`, 'value', {cut}, "
                     f"'start', cs.`start`, 'end', cs.`start` + char_length({cut}), 'ord', cs.`ord`), NULL)")
            sp = f"filter(transform({sp}, cs -> IF({chk}, cs, {retry})), cs -> cs IS NOT NULL)"
        elif chk is not None:
            sp = f"filter({sp}, cs -> {chk})"
        parts.append(f"IF(size({v}) > 0, {sp}, {S.EMPTY_SPANS})")
    concat = f"concat({', '.join(parts)})" if parts else S.EMPTY_SPANS
    raw = F.expr(f"IF({S.q(count_col)} <= {int(cap)}, {concat}, NULL)")
    return df.select(*base, raw.alias(out_col), F.col(count_col))


def find_literals(
    df: DataFrame,
    text_col: str,
    terms: Sequence[str],
    out_col: str,
    count_col: str,
    etype: str,
    ord_: int,
    cap: int,
    prefix: str,
) -> DataFrame:
    """M1: non-overlapping, case-sensitive occurrences of each literal term.

    One ``split`` per term (gated by a literal ``instr``); null spans when the total
    number of occurrences exceeds ``cap``.
    """
    text = F.col(text_col)
    base = df.columns
    if not terms:
        return df.select("*", empty_spans().alias(out_col), F.lit(0).alias(count_col))
    gcols = []
    stage1 = []
    for i, term in enumerate(terms):
        gcols.append(f"{prefix}_t{i}")
        g = F.when(F.instr(text, term) > 0, F.split(text, quote_literal(term), -1)).otherwise(F.array(text))
        stage1.append(g.alias(gcols[-1]))
    total = " + ".join(f"coalesce(size({S.q(c)}) - 1, 0)" for c in gcols)
    df = df.select("*", *stage1).select("*", F.expr(total).alias(count_col))
    parts = [S.literal_spans(S.q(c), term, etype, ord_) for c, term in zip(gcols, terms)]
    spans = F.expr(f"IF({S.q(count_col)} <= {int(cap)}, concat({', '.join(parts)}), NULL)")
    return df.select(*base, spans.alias(out_col), F.col(count_col))

"""Detection, policy and masking (R1-R19, D2-D3, M1-M12) over a text column.

``anonymize`` is one narrow pipeline - no shuffle unless external spans or a hash key
are joined in - so it runs the same on a batch table and on a stream:

    validate -> literal terms -> detect -> resolve -> block check -> whitelist ->
    blacklist -> final resolve -> numbering -> replacement -> mapping rows
"""

from __future__ import annotations

import secrets
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard import errors as E
from textguard.functions import hashing
from textguard.functions import sqltext as S
from textguard.functions.patterns import (
    CUSTOM_TYPE, builtin, MAX_ENTITIES, MAX_LITERAL_MATCHES, SECRET_TYPES,
    SUPPORTED_LANGUAGES, MODE_EXTERNAL, MODE_REGEX, Recognizer,
)
from textguard.functions.spans import (
    add_resolved, empty_spans, find_literals, find_spans, span,
)
from textguard.operators import validate as V
from textguard.operators.partitioning import spread
from textguard.session import written

MAX_MAPPING_BYTES = 100 * 1024 * 1024
_P = "_tg"  # prefix of internal columns

ENTITY_TYPE = T.StructType([
    T.StructField("etype", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("placeholder", T.StringType()),
])
MAPPING_ENTRY = T.StructType([T.StructField("placeholder", T.StringType()), T.StructField("value", T.StringType())])


def custom_recognizers(custom_patterns: Mapping[str, str] | None) -> list[Recognizer]:
    """Caller patterns (Java regex), run first in the given order."""
    out = []
    for name, pattern in (custom_patterns or {}).items():
        if not isinstance(name, str) or not name or not isinstance(pattern, str) or not pattern:
            raise ValueError("custom patterns need a name and a non-empty regex")
        out.append(Recognizer(name, pattern))
    return out


def recognizer_plan(custom_patterns: Mapping[str, str] | None = None,
                    only: Sequence[Recognizer] | None = None, mask_pem_body: bool = False) -> list[tuple[Recognizer, int]]:
    recs = custom_recognizers(custom_patterns) + list(only if only is not None else builtin(mask_pem_body))
    return [(r, i) for i, r in enumerate(recs)]


def is_secret(s: Column) -> Column:
    return s["etype"].isin(*SECRET_TYPES)


def detect(
    df: DataFrame,
    text_col: str = "text",
    *,
    custom_patterns: Mapping[str, str] | None = None,
    recognizers: Sequence[Recognizer] | None = None,
    out_col: str = "entities",
    resolve: bool = True,
    external_spans: DataFrame | None = None,
    key_cols: Sequence[str] = (),
    lang_col: str | None = None,
    external_languages: Sequence[str] = SUPPORTED_LANGUAGES,
    mask_pem_body: bool = False,
    iban_backoff: bool = False,
    spread_input: bool = True,
) -> DataFrame:
    """Detected spans per row.

    ``out_col`` is ``array<struct<etype,value,start,end,ord>>`` sorted by start (resolved)
    or in detection order (raw). ``{out_col}_error`` is set when the entity cap is exceeded.
    External (NER) spans, when given, are ``(key_cols..., etype, start, end, score)``.
    """
    plan = recognizer_plan(custom_patterns, recognizers, mask_pem_body)
    raw_col, n_col = f"{_P}_raw", f"{_P}_nraw"
    out = find_spans(spread(df) if spread_input else df, text_col, plan, raw_col, n_col, iban_backoff=iban_backoff)
    over = F.col(n_col) > MAX_ENTITIES
    merged = F.col(raw_col)
    if external_spans is not None:
        out, merged, over = _merge_external(out, text_col, external_spans, key_cols, lang_col, external_languages, raw_col, over)
    out = out.withColumn(f"{_P}_over", over)
    over = F.col(f"{_P}_over")
    if resolve:
        out = add_resolved(out, F.when(~over, merged), out_col)
    else:
        out = out.withColumn(out_col, F.when(~over, merged))
    return (out.withColumn(f"{out_col}_error", F.when(over, E.error(E.VALIDATION_ERROR)).otherwise(E.no_error()))
            .drop(raw_col, n_col, f"{_P}_over", f"{_P}_extspans", f"{_P}_regres"))


def _merge_external(df, text_col, ext, key_cols, lang_col, languages, raw_col, over):
    """Spans from an external analyzer (score >= 0.5) + regex spans, re-resolved.

    The external table is reduced to one array per row key (bounded by the text length:
    spans are non-empty ranges of one text) and joined on the key.
    """
    if not key_cols:
        raise ValueError("external spans need key columns to join on")
    ext_agg = (ext.filter(F.col("score") >= 0.5)
               .groupBy(*key_cols)
               .agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"),
                                            F.col("end").cast("int").alias("end"),
                                            F.col("etype").alias("etype"))).alias(f"{_P}_ext")))
    df = df.join(ext_agg, list(key_cols), "left")
    use = F.lit(True) if lang_col is None else F.col(lang_col).isin(*languages)
    text = F.col(text_col)
    ext_spans = F.transform(
        F.array_sort(F.coalesce(F.col(f"{_P}_ext"), F.array().cast("array<struct<start:int,end:int,etype:string>>"))),
        lambda e: span(e["etype"], F.substring(text, e["start"] + 1, e["end"] - e["start"]), e["start"], e["end"], -1),
    )
    ext_spans = F.when(use, ext_spans).otherwise(empty_spans())
    df = df.withColumn(f"{_P}_extspans", ext_spans)
    n_ext = F.size(F.col(f"{_P}_extspans"))
    # Regex spans are resolved among themselves first, then merged behind the external ones.
    df = add_resolved(df, F.col(raw_col), f"{_P}_regres")
    regex_resolved = F.coalesce(F.col(f"{_P}_regres"), empty_spans())
    merged = F.concat(F.col(f"{_P}_extspans"), regex_resolved)
    over2 = over | (n_ext > MAX_ENTITIES) | ((n_ext + F.size(regex_resolved)) > MAX_ENTITIES)
    return df.drop(f"{_P}_ext"), merged, over2


def detector_modes(languages: Sequence[str] = SUPPORTED_LANGUAGES,
                   external_languages: Sequence[str] | None = None) -> dict[str, str]:
    """The external mode where external spans are configured for the language, else the regex mode."""
    ext = set(external_languages or ())
    return {lang: (MODE_EXTERNAL if lang in ext else MODE_REGEX) for lang in languages}


@dataclass
class Anonymized:
    masked: DataFrame
    mapping: DataFrame
    shared: DataFrame | None = None  # the persisted pass when ``reuse`` is set

    def release(self) -> None:
        """Drop the persisted pass (``reuse``) once every consumer has run."""
        if self.shared is not None:
            self.shared.unpersist()


def anonymize(
    df: DataFrame,
    text_col: str = "text",
    *,
    language: str = "de",
    lang_col: str | None = None,
    strategy: str = "placeholder",
    on_secret: str = "mask",
    whitelist: Sequence[str] | None = None,
    blacklist: Sequence[str] | None = None,
    custom_patterns: Mapping[str, str] | None = None,
    recognizers: Sequence[Recognizer] | None = None,
    external_spans: DataFrame | None = None,
    external_languages: Sequence[str] = SUPPORTED_LANGUAGES,
    key_cols: Sequence[str] = (),
    principal_col: str | None = None,
    created_at: datetime | str | None = None,
    hash_key: bytes | None = None,
    key_table: DataFrame | None = None,
    run_token: str | None = None,
    blacklist_beats_secrets: bool = False,
    keep_entities: bool = False,
    reuse: bool | StorageLevel = False,
    mask_pem_body: bool = False,
    iban_backoff: bool = False,
    spread_input: bool = True,
) -> Anonymized:
    """Mask every row of ``text_col``; return (masked rows, mapping rows).

    ``key_cols`` must be unique per row (the mapping fails if they are not); without them ids are drawn
    once and the input is written to the shared folder with them (a stream is refused). Input columns named like
    an added column are refused.

    Added columns: ``anonymized_text``, ``pii_count``, ``session_id`` (placeholder strategy
    with at least one entity), ``strategy`` (otherwise), ``error``. The mapping DataFrame
    has one row per session: ``session_id, principal_id, created_at, size_bytes, mappings``
    plus ``key_cols``; it holds original values and is never written by this function.

    ``reuse=True`` persists the shared result (memory and disk) so the masked rows and the
    mapping rows - and any further consumers - are derived from one detection pass;
    recomputation after a lost executor is deterministic (session ids included). A storage level
    is used as given: ``DISK_ONLY`` for tables that may outgrow the executors, as texts that are
    kept in memory can fill a small heap before Spark moves any of them to disk.

    ``mask_pem_body=True`` (opt-in) masks a whole PEM block instead of its header line only.
    ``iban_backoff=True`` (opt-in) retries an IBAN candidate that swallowed following words,
    cut to its country's length (the original leaves such an IBAN visible).
    ``spread_input=False`` takes the input's partitions as they are: counting those of a joined
    input runs its shuffles once more.

    ``blacklist_beats_secrets=True`` reproduces the original rule that a blacklist term
    overlapping a secret drops the secret span (which can leave part of it visible);
    the default keeps such secret spans so the final pass masks them whole.
    """
    V.check_options(strategy, on_secret)
    wl = V.check_terms("whitelist", whitelist)
    bl = V.check_terms("blacklist", blacklist)
    base_cols = df.columns
    clash = sorted({"anonymized_text", "pii_count", "session_id", "strategy", "error", "entities"} & set(base_cols))
    if clash:
        raise ValueError(f"rename the input columns {clash}: the result has columns of these names")
    text = F.col(text_col)
    lang = F.col(lang_col) if lang_col else F.lit(language)
    run_token = run_token or secrets.token_hex(16)
    spark = df.sparkSession
    row_id = list(key_cols)
    if strategy == "placeholder":
        if not row_id:  # ids are drawn once and written with the rows, so every consumer sees the same
            if df.isStreaming:
                raise ValueError("reversible masking of a stream needs key_cols: ids drawn per query would differ between masked and mapping rows")
            df = written(df.withColumn(f"{_P}_uid", F.expr("uuid()")), "keyed-input")
            row_id = [f"{_P}_uid"]
        df = hashing.with_token(df, run_token)

    # V1/V2: row validation; rejected rows are not scanned.
    out = (spread(df) if spread_input else df).withColumn(f"{_P}_verr", V.anonymize_request_error(text, lang))
    out = out.withColumn(f"{_P}_scan", F.when(F.col(f"{_P}_verr").isNull(), text))
    scan = f"{_P}_scan"

    # M1: literal whitelist/blacklist ranges (with their own caps).
    out = find_literals(out, scan, wl, f"{_P}_wl", f"{_P}_nwl", CUSTOM_TYPE, 10**6, MAX_LITERAL_MATCHES, f"{_P}w")
    out = find_literals(out, scan, bl, f"{_P}_bl", f"{_P}_nbl", CUSTOM_TYPE, 10**6, MAX_LITERAL_MATCHES, f"{_P}b")

    # R1-R19 + D2/D3.
    out = detect(out, scan, custom_patterns=custom_patterns, recognizers=recognizers, out_col=f"{_P}_det",
                 external_spans=external_spans, key_cols=key_cols, lang_col=lang_col,
                 external_languages=external_languages, mask_pem_body=mask_pem_body,
                 iban_backoff=iban_backoff, spread_input=False)
    det = F.col(f"{_P}_det")

    err = E.first_error(
        (F.col(f"{_P}_verr").isNotNull(), E.VALIDATION_ERROR),
        (F.col(f"{_P}_nwl") > MAX_LITERAL_MATCHES, E.VALIDATION_ERROR),
        (F.col(f"{_P}_nbl") > MAX_LITERAL_MATCHES, E.VALIDATION_ERROR),
        (F.col(f"{_P}_det_error").isNotNull(), E.VALIDATION_ERROR),
        (F.size(det) > MAX_ENTITIES, E.VALIDATION_ERROR),
        (F.lit(on_secret == "block") & F.exists(det, is_secret), E.PROHIBITED_SECRET),
    )
    out = out.withColumn("error", err)

    # M2/M3/M4: whitelist never releases secrets; blacklist adds CUSTOM spans and wins.
    det_s, wl_s, bl_s = S.q(f"{_P}_det"), S.q(f"{_P}_wl"), S.q(f"{_P}_bl")
    kept = f"filter({det_s}, s -> {S.is_secret('s')} OR NOT {S.overlaps_any('s', wl_s)})" if wl else det_s
    if bl:
        keep_secret = "" if blacklist_beats_secrets else f"{S.is_secret('s')} OR "
        kept = f"filter({kept}, s -> {keep_secret}NOT {S.overlaps_any('s', bl_s)})"
        out = add_resolved(out, f"IF(error IS NULL, concat({kept}, {bl_s}), NULL)", f"{_P}_final")
    else:
        out = out.withColumn(f"{_P}_final", F.expr(f"IF(error IS NULL, {kept}, NULL)"))

    # M6: per type, left to right, one index per distinct value. Native array functions
    # (array_remove, array_position) instead of per-element lambdas keep this cheap.
    fin, dv, dt, num = (S.q(f"{_P}_{x}") for x in ("final", "dv", "dt", "num"))
    out = out.withColumn(f"{_P}_dv", F.expr(
        f"array_distinct(transform({fin}, s -> named_struct('etype', s.`etype`, 'value', s.`value`)))"))
    out = out.withColumn(f"{_P}_dt", F.expr(f"transform({dv}, x -> x.`etype`)"))
    out = out.withColumn(f"{_P}_num", F.expr(f"transform({dv}, (x, i) -> i - size(array_remove(slice({dt}, 1, i), x.`etype`)))"))
    placeholder = (f"concat('<', s.`etype`, '_', CAST({num}[array_position({dv}, named_struct('etype', s.`etype`, "
                   f"'value', s.`value`)) - 1] AS STRING), '>')")
    out = out.withColumn(f"{_P}_ents", F.expr(
        f"transform({fin}, s -> named_struct('etype', s.`etype`, 'value', s.`value`, 'start', s.`start`, "
        f"'end', s.`end`, 'placeholder', {placeholder}))"))

    # Replacement text per entity.
    if strategy == "hash":
        keys = key_table if key_table is not None else hashing.key_table(spark, hash_key)
        out = out.withColumn("_tg_hk", F.lit(0)).join(F.broadcast(keys), "_tg_hk").drop("_tg_hk")
    ents_s = S.q(f"{_P}_ents")
    if strategy == "placeholder":
        repl = "s.`placeholder`"
    elif strategy == "redact":
        repl = f"IF(s.`etype` = '{CUSTOM_TYPE}', s.`placeholder`, concat('[REDACTED_', s.`etype`, ']'))"
    else:
        digest = ("substring(sha2(concat(_tg_opad, unhex(sha2(concat(_tg_ipad, encode(s.`value`, 'UTF-8')), 256))), 256), 1, 16)")
        repl = f"IF(s.`etype` = '{CUSTOM_TYPE}', s.`placeholder`, concat('<HASH_', s.`etype`, '_', {digest}, '>'))"
    t = S.q(text_col)
    prev_end = f"IF(i = 0, 0, {ents_s}[i - 1].`end`)"
    masked = F.expr(
        f"concat(array_join(transform({ents_s}, (s, i) -> concat(substring({t}, {prev_end} + 1, s.`start` - {prev_end}), {repl})), ''), "
        f"substring({t}, coalesce(try_element_at({ents_s}, -1).`end`, 0) + 1))")
    ents_c = F.col(f"{_P}_ents")

    mappings = F.expr(f"array_distinct(transform({ents_s}, s -> named_struct('placeholder', s.`placeholder`, 'value', s.`value`)))")
    size_bytes = F.expr(
        f"aggregate(transform(array_distinct(transform({ents_s}, s -> named_struct('placeholder', s.`placeholder`, "
        f"'value', s.`value`))), m -> octet_length(m.`placeholder`) + octet_length(m.`value`)), 0L, (a, b) -> a + b)")
    count = F.size(ents_c)
    reversible = F.lit(strategy == "placeholder") & (count > 0)
    sid = hashing.session_id(*[F.col(c) for c in row_id]) if strategy == "placeholder" else F.lit(None).cast("string")

    out = out.select(
        *[F.col(c) for c in base_cols],
        *[F.col(c) for c in (*row_id, f"{_P}_token") if c not in base_cols and strategy == "placeholder"],
        F.when(F.col("error").isNull(), masked).alias("anonymized_text"),
        F.when(F.col("error").isNull(), count).alias("pii_count"),
        ents_c.alias(f"{_P}_ents"),
        mappings.alias(f"{_P}_map"),
        size_bytes.alias(f"{_P}_size"),
        F.col("error"),
    )
    # T9 (single mapping over budget) only applies to reversible runs.
    oversize = F.lit(strategy == "placeholder") & (F.col(f"{_P}_size") > MAX_MAPPING_BYTES)
    out = out.withColumn("error", F.when(F.col("error").isNull() & oversize, E.error(E.RESOURCE_TOO_LARGE)).otherwise(F.col("error")))
    ok = F.col("error").isNull()
    rev = ok & reversible
    out = (out.withColumn("session_id", F.when(rev, sid))
              .withColumn("strategy", F.when(ok & ~reversible, F.lit(strategy)))
              .withColumn("anonymized_text", F.when(ok, F.col("anonymized_text")))
              .withColumn("pii_count", F.when(ok, F.col("pii_count"))))

    if isinstance(created_at, str):
        created = F.col(created_at).cast("timestamp")
    else:
        created = F.lit(created_at or datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    principal = F.col(principal_col).cast("string") if principal_col else F.lit(None).cast("string")
    if reuse:
        out = out.persist(StorageLevel.MEMORY_AND_DISK if reuse is True else reuse)
    # Mapping rows come out of a generator (0 or 1 per input row) rather than a filter on
    # the derived session id: a Filter would be pushed down through the projections and
    # inline the whole masking expression into its predicate.
    mapping_row = F.struct(
        *[F.col(c).alias(c) for c in key_cols],
        F.col("session_id").alias("session_id"),
        principal.alias("principal_id"),
        created.alias("created_at"),
        F.col(f"{_P}_size").alias("size_bytes"),
        F.col(f"{_P}_map").alias("mappings"),
    )
    mapping = out.select(F.inline(F.when(F.col("session_id").isNotNull(), F.array(mapping_row))
                                  .otherwise(F.array().cast(T.ArrayType(mapping_row_type(out, key_cols))))))
    if key_cols and not out.isStreaming:  # keys that repeat would share a session: fail instead
        same = F.count("*").over(Window.partitionBy("session_id"))
        mapping = mapping.withColumn(f"{_P}_same", same).withColumn("session_id", F.when(
            F.col(f"{_P}_same") == 1, F.col("session_id")).otherwise(F.raise_error(F.lit("key columns are not unique")))).drop(f"{_P}_same")
    masked_cols = [F.col(c) for c in out.columns if not c.startswith(_P)]
    if keep_entities:
        masked_cols.append(F.when(ok, F.col(f"{_P}_ents")).alias("entities"))
    return Anonymized(barrier(out.select(*masked_cols)), mapping, out if reuse else None)


def mapping_row_type(out: DataFrame, key_cols: Sequence[str]) -> T.StructType:
    fields = [T.StructField(c, out.schema[c].dataType) for c in key_cols]
    return T.StructType(fields + [
        T.StructField("session_id", T.StringType()),
        T.StructField("principal_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("mappings", T.ArrayType(MAPPING_ENTRY)),
    ])


def barrier(df: DataFrame) -> DataFrame:
    """Re-emit every column through a one-element ``inline``.

    Filters that callers put on derived columns (``error``, ``pii_count``...) then stay
    above the generator instead of being pushed into - and duplicating - the masking
    expressions. Costs one struct per row.
    """
    cols = df.columns
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in cols]))))


def anonymize_columns(df: DataFrame, text_cols: Sequence[str], **kwargs) -> DataFrame:
    """Mask several text columns in one narrow stage.

    Each column is replaced by its masked text; ``<col>_pii_count`` and ``<col>_error`` are
    added. Non-reversible strategies only: each reversible column would need its own mapping
    scope, so use ``anonymize`` per column for placeholders.
    """
    strategy = kwargs.get("strategy", "placeholder")
    if strategy == "placeholder":
        raise ValueError("anonymize_columns supports the redact and hash strategies")
    out = df
    for c in text_cols:
        a = anonymize(out, c, **kwargs).masked
        keep = [x for x in out.columns if x != c]
        out = a.select(*keep, F.col("anonymized_text").alias(c), F.col("pii_count").alias(f"{c}_pii_count"),
                       F.col("error").alias(f"{c}_error"))
    return out

"""Value-free audit aggregates (G1-G5), JSON encoding (S6) and the public projection.

Inputs are the outputs of ``anonymize`` (masked rows with ``entities``), ``restore`` and
the mapping table. No output column carries a value, an id or a text.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions.patterns import MODE_EXTERNAL, MODE_REGEX, SUPPORTED_LANGUAGES

MAX_STATS_BYTES = 64 * 1024

# The keys a public consumer may see, in snapshot order.
PUBLIC_KEYS = (
    "total_anonymizations", "total_deanonymizations", "total_pii_entities", "entities_by_type",
    "blocked_pii_types", "expired_sessions", "failed_deanonymizations", "active_sessions",
    "detector_mode", "detector_modes", "supported_languages",
)

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("total_anonymizations", T.LongType()),
    T.StructField("total_deanonymizations", T.LongType()),
    T.StructField("total_pii_entities", T.LongType()),
    T.StructField("entities_by_type", T.MapType(T.StringType(), T.LongType())),
    T.StructField("blocked_pii_types", T.MapType(T.StringType(), T.LongType())),
    T.StructField("expired_sessions", T.LongType()),
    T.StructField("failed_deanonymizations", T.LongType()),
    T.StructField("active_sessions", T.LongType()),
    T.StructField("detector_mode", T.StringType()),
    T.StructField("detector_modes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("supported_languages", T.ArrayType(T.StringType())),
])


def anonymization_totals(masked: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """G1 (anonymize side): calls counted even with zero entities; rejected rows are not counted."""
    ok = F.col("error").isNull()
    return masked.groupBy(*group_cols).agg(
        F.count_if(ok).alias("total_anonymizations"),
        F.coalesce(F.sum(F.when(ok, F.col("pii_count"))), F.lit(0)).cast("long").alias("total_pii_entities"),
    )


def restore_totals(restored: DataFrame) -> DataFrame:
    """G1 (restore side): successful and failed restores."""
    return restored.agg(
        F.count_if(F.col("error").isNull()).alias("total_deanonymizations"),
        F.count_if(F.col("error").isNotNull()).alias("failed_deanonymizations"),
    )


def entities_by_type(masked: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Occurrences per entity type (``blocked_pii_types`` is the same count).

    ``explode`` keeps work per row; the group-by pre-aggregates map-side, so a dominant
    type costs one partial count per partition, not a hot shuffle key.
    """
    ents = masked.filter(F.col("error").isNull()).select(*group_cols, F.explode("entities").alias("e"))
    return ents.groupBy(*group_cols, F.col("e.etype").alias("etype")).agg(F.count(F.lit(1)).alias("n"))


def session_counts(mapping: DataFrame, as_of: datetime | Column, ttl_seconds: int = 3600) -> DataFrame:
    """Live (age <= ttl at ``as_of``) and expired sessions."""
    as_of_c = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    age = F.unix_micros(as_of_c.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    live = age <= F.lit(int(ttl_seconds * 1_000_000)).cast("long")
    return mapping.agg(F.count_if(live).alias("active_sessions"), F.count_if(~live).alias("expired_sessions"))


def snapshot(masked: DataFrame, restored: DataFrame | None, mapping: DataFrame, as_of: datetime,
             ttl_seconds: int = 3600, detector_modes: dict[str, str] | None = None,
             languages: Sequence[str] = SUPPORTED_LANGUAGES) -> DataFrame:
    """One row with every counter; maps sorted by key.

    The partial aggregates (each one row, or one row per type) are stacked with
    ``unionByName`` and folded by a single global aggregation - no joins.
    """
    modes = detector_modes or {lang: MODE_REGEX for lang in languages}
    overall = MODE_EXTERNAL if any(v == MODE_EXTERNAL for v in modes.values()) else MODE_REGEX
    parts = [anonymization_totals(masked), entities_by_type(masked), session_counts(mapping, as_of, ttl_seconds)]
    if restored is not None:
        parts.append(restore_totals(restored))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    if "total_deanonymizations" not in u.columns:
        u = u.withColumn("total_deanonymizations", F.lit(None).cast("long")).withColumn(
            "failed_deanonymizations", F.lit(None).cast("long"))
    counter = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    types = F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("etype").isNotNull(), F.struct(F.col("etype").alias("key"), F.col("n").cast("long").alias("value"))))))
    agg = u.agg(
        counter("total_anonymizations"), counter("total_deanonymizations"), counter("total_pii_entities"),
        types.alias("entities_by_type"), counter("expired_sessions"), counter("failed_deanonymizations"),
        counter("active_sessions"),
    )
    mode_map = F.create_map(*[x for k in sorted(modes) for x in (F.lit(k), F.lit(modes[k]))])
    return agg.select(
        "total_anonymizations", "total_deanonymizations", "total_pii_entities", "entities_by_type",
        F.col("entities_by_type").alias("blocked_pii_types"), "expired_sessions", "failed_deanonymizations",
        "active_sessions", F.lit(overall).alias("detector_mode"), mode_map.alias("detector_modes"),
        F.array(*[F.lit(x) for x in languages]).alias("supported_languages"),
    )


def to_json_text(snap: DataFrame) -> DataFrame:
    """The snapshot as one JSON object per row."""
    return snap.select(F.to_json(F.struct(*[F.col(c) for c in snap.columns])).alias("json"))


def public_projection(json_text: Column) -> Column:
    """Keep only the allowed keys of a JSON object, each value as it is (explicit nulls, fractions and
    nested objects included); null when over 64 KiB, not valid JSON as a whole, or not an object."""
    v = F.try_parse_json(F.concat(F.lit("["), json_text, F.lit("]")))  # in brackets, text after the object is an error

    def pair(key: str) -> Column:
        value = F.variant_get(v, f"$[0].{key}", "variant")
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), F.to_json(value)))

    pairs = F.array_compact(F.array(*[pair(f.name) for f in SNAPSHOT_SCHEMA.fields]))
    is_object = F.schema_of_variant(F.variant_get(v, "$[0]", "variant")).startswith("OBJECT") & F.variant_get(v, "$[1]", "variant").isNull()
    return F.when((F.octet_length(json_text) <= MAX_STATS_BYTES) & is_object, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))

"""Hashed n-gram counts and log-ratio tables, shared by importance resampling and the quality rules."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

BUCKET_BITS = 16
#: Up to this many labelled ids are sent to every task (16 bytes each); beyond it the texts are dealt by id.
BROADCAST_IDS = 500_000
#: Odd 64-bit multipliers that spread word hashes over the buckets.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def ngram_buckets(tokens: list[bytes], bits: int = BUCKET_BITS) -> np.ndarray:
    """Bucket of every unigram and bigram of a token list."""
    h = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * SPREAD[1] + h[1:] * SPREAD[2]
    return (np.concatenate([h * SPREAD[0], pairs * SPREAD[0]]) >> np.uint64(64 - bits)).astype(np.int64)


def lower_tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased: what ``bytes`` methods do by definition."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ngram_counts(docs: DataFrame, text_col: str, target_col: str, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over the target rows and over all rows (two vectors of 2^bits numbers).

    Each task sums its own vectors, so the shuffle has a row per bucket and task, whatever the texts.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, is_target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = lower_tokens(text)
                if tokens:
                    own = ngram_buckets(tokens, bits)
                    np.add.at(raw, own, 1)
                    if is_target:
                        np.add.at(target, own, 1)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(target[full])], names=["bucket", "raw", "target"])

    parts = docs.select(text_col, target_col).mapInArrow(count, "bucket long, raw long, target long")
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for row in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # 2^bits rows at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of the two smoothed multinomials' ratio per bucket; zero everywhere without target rows."""
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    return (np.log((target + smoothing) / (target.sum() + smoothing * len(target)))
            - np.log((raw + smoothing) / (raw.sum() + smoothing * len(raw)))).astype(np.float32)


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, kinds: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``kind, text`` of every row of ``docs`` that ``kinds`` (id, kind) names, stored. Of an id with several kinds the least counts.

    Stored, lest a later function runs below the join, on every row.
    """
    ids = kinds.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled_id")).agg(F.min("kind").alias("kind"))
    ids = stored(ids, "labelled-ids")
    ids = ids.hint("broadcast" if ids.count() <= broadcast_ids else "shuffle_hash")  # the texts are never sorted
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(rows.join(ids, F.col("id") == F.col("labelled_id")).select("kind", "text"), "labelled-rows")


def labelled_sample(labels: DataFrame, id_col: str, flag, rows: int) -> DataFrame:
    """At most ``rows`` ids of the labelled rows that ``flag`` holds for, in hash order: a bounded, repeatable sample."""
    ids = labels.where(flag & F.col(id_col).isNotNull()).select(id_col).distinct()
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(rows)

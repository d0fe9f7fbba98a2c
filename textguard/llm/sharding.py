"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

The hash of a row is 60 bits of its key followed by 60 bits of the row's own number, so that rows of
one hot key (or exact repeats) can be split too. Bytes are summed per prefix of some depth first; the
directory is then found on these few sums: a bucket that exceeds the limit splits on the next bit.
Prefixes that are still too large at that depth go on with more bits, and only their rows are read again.

Defined results: a null key hashes like the empty text, a null size is 0 bytes, a row larger than the
limit gets a shard of its own, an empty table gives no rows, other input columns are not carried along.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY_BITS, ALL_BITS = 60, 120


def _bits60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    key = F.lpad(F.bin("h1"), KEY_BITS, "0")
    if depth <= KEY_BITS:
        return F.substring(key, 1, depth)
    return F.substring(F.concat(key, F.lpad(F.bin("h2"), KEY_BITS, "0")), 1, depth)


def _directory(cells: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """``cells`` has prefix, bytes, n at ``depth``. Returns each cell with its bucket, or null if it must split on."""
    spread = cells.select(F.col("prefix").alias("cell"), "bytes", "n", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"))
    spread = spread.withColumn("prefix", F.expr("substring(cell, 1, d)"))
    buckets = spread.groupBy("prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1)
    if depth == ALL_BITS:  # no bits are left: rows whose 120 bits agree stay together
        fits |= F.length("prefix") == ALL_BITS
    leaf = F.struct("d", F.col("prefix").alias("shard"), "shard_bytes", "shard_rows")
    return spread.join(buckets.where(fits), "prefix", "left").groupBy("cell").agg(
        F.min(F.when(F.col("shard_bytes").isNotNull(), leaf)).alias("leaf")
    )


def shard_rows(df: DataFrame, key_col: str, size: Column, limit: int) -> DataFrame:
    """``key_col``, bytes, shard (prefix bits), depth, shard_bytes, shard_rows for every row."""
    narrow = stored(
        df.select(F.col(key_col).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
        .select("key", "bytes", _bits60(F.coalesce(F.col("key").cast("string"), F.lit(""))).alias("h1"), _bits60(F.col("row").cast("string")).alias("h2")),
        "shard-rows",
    )
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    base, depth = 0, min(KEY_BITS, max(0, ceil(log2(max(total / limit, 1)))) + 3)
    done, rows, step = [], narrow, 8
    while True:
        cells = rows.groupBy(_prefix(depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        found = stored(_directory(cells, base, depth, limit), "shard-directory")
        leaves = found.where("leaf is not null").select("cell", "leaf.*")
        done.append(rows.withColumn("cell", _prefix(depth)).join(leaves, "cell").select(
            F.col("key").alias(key_col), "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows"))
        over = found.where("leaf is null").select("cell")
        if depth == ALL_BITS or over.isEmpty():
            break
        rows = rows.withColumn("cell", _prefix(depth)).join(over, "cell", "left_semi").drop("cell")
        base, depth, step = depth + 1, min(ALL_BITS, depth + step), step * 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(df: DataFrame, assigned: DataFrame, key_col: str, path: str) -> None:
    """Write the rows of ``df`` as one folder per shard. Keys must be unique in both tables."""
    placed = df.join(assigned.select(key_col, "shard"), key_col)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)

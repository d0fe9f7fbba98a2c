"""Partitioning helpers for CPU-heavy row work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a batch input has fewer partitions than the cluster has cores.

    Masking is regex-bound per row, so parallelism matters more than the one shuffle of
    the text. Large inputs already have enough file splits and pass through untouched;
    streaming inputs are left alone.
    """
    if df.isStreaming:
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)

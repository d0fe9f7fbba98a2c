"""Parquet table sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test schema; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_source(spark: SparkSession, path: str, text_col: str = "text", fmt: str = "parquet",
                streaming: bool = False, schema=None) -> DataFrame:
    """Any table (or stream) with a string column to mask."""
    reader = spark.readStream if streaming else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    if text_col not in df.columns:
        raise ValueError(f"text column {text_col!r} not found")
    return df


def corpus_source(spark: SparkSession, path: str, allowed_projects, fmt: str = "parquet") -> DataFrame:
    """S3: a shared corpus table (``vector, text, project_id, source``) opened by path.

    A configured shared store must come with an explicit, non-empty project allowlist: a
    deployment typo must not turn into global search. Rows of other projects are filtered at
    the scan (partition pruning when the table is partitioned by ``project_id``).
    """
    projects = sorted(set(allowed_projects or ()))
    if not projects:
        raise ValueError("an allowlist of projects is required for a shared corpus")
    from pyspark.sql import functions as F
    df = spark.read.format(fmt).load(path)
    return df.filter(F.col("project_id").isin(*projects))

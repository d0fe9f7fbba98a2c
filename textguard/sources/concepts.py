"""Concept source (S2): Markdown files ``<id>.md`` under a root folder, read with ``binaryFile``.

Ids must fully match ``[A-Za-z0-9_-]+``; files over ``max_bytes`` fail with
``resource_too_large`` and their content is never read (the ``length`` filter is
pushed into the file source); invalid UTF-8 fails with ``concept_not_found``. Front
matter is kept verbatim. Symbolic links cannot be told apart through ``binaryFile``
and are followed (documented limit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import errors as E

MAX_CONCEPT_BYTES = 1024 * 1024
ID_RE = r"\A[A-Za-z0-9_-]+\z"


def read_concepts(spark: SparkSession, root: str, max_bytes: int = MAX_CONCEPT_BYTES,
                  recursive: bool = False) -> DataFrame:
    """Rows ``(concept_id, path, length, content, error)``; ``content`` is null on error."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.md")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(root)
    cid = F.regexp_extract(F.col("path"), r"([^/]*)\.md$", 1)
    # Metadata-only scan: the content column is pruned, so no file body is read.
    meta = files.select("path", "length", cid.alias("concept_id"))
    # Content scan only for files within the limit (the length predicate reaches the source).
    small = files.filter(F.col("length") <= max_bytes).select("path", F.col("content"))
    j = meta.join(small, "path", "left")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    err = E.first_error(
        (~F.coalesce(F.col("concept_id").rlike(ID_RE), F.lit(False)), E.CONCEPT_NOT_FOUND),
        (F.col("length") > max_bytes, E.RESOURCE_TOO_LARGE),
        (text.isNull(), E.CONCEPT_NOT_FOUND),
    )
    out = j.withColumn("error", err)
    return out.select("concept_id", "path", "length", F.when(F.col("error").isNull(), text).alias("content"), "error")


def read_concept(concepts: DataFrame, concept_id: str) -> DataFrame:
    """One id lookup; an id that is malformed or absent yields one ``concept_not_found`` row."""
    import re
    if not re.fullmatch(r"[A-Za-z0-9_-]+", concept_id or ""):
        spark = concepts.sparkSession
        return spark.createDataFrame([(concept_id, None, E.CONCEPT_NOT_FOUND, E.MESSAGES[E.CONCEPT_NOT_FOUND])],
                                     "concept_id string, content string, code string, message string") \
            .select("concept_id", "content", F.struct("code", "message").alias("error"))
    hit = concepts.filter(F.col("concept_id") == concept_id).select("concept_id", "content", "error")
    miss = concepts.sparkSession.range(1).select(
        F.lit(concept_id).alias("concept_id"), F.lit(None).cast("string").alias("content"),
        E.error(E.CONCEPT_NOT_FOUND).alias("error"))
    return hit.unionByName(miss.join(hit.select("concept_id"), "concept_id", "left_anti"))

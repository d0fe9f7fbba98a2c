"""Training-corpus pipeline: from raw documents to packed token sequences.

Each stage gets what the stage before kept, written as Parquet and read again. All stages but the last return the
columns of ``documents``. Rows without text stay until packing, where they are one end id; an empty table passes
through; additional columns of the documents pass through unchanged up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.common import fold_of, stored, table
from textguard.llm.decontaminate import contained_items
from textguard.llm.packing import pack
from textguard.llm.quality_rules import fit_quality
from textguard.llm.queries import public_encoder
from textguard.llm.setsketch import near_duplicates
from textguard.llm.toxicity import fit_toxicity


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not in ``ids``; a null id counts as a value."""
    gone = ids.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def _spare_name(docs: DataFrame) -> str:
    name = "measured"
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score of 0.5 or more go; held-out labels are not learnt from."""
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0)
    model = fit_toxicity(docs, labels)
    return docs.where(model.column(F.col("text")) < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a base rule or the likelihood ratio rejects go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    name = _spare_name(docs)
    return docs.withColumn(name, model.columns(F.col("text"))).where(model.kept(F.col(name))).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component the row with the least id stays; of rows that share an id, one. Rows without an id stay."""
    found = stored(near_duplicates(docs, width=5), "kept-documents")
    rows = _without(docs, found.where("not kept"))
    twice = stored(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return rows
    return _without(rows, twice).unionByName(rows.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, each row judged by itself, also where ids are null or repeated."""
    row = _spare_name(docs)
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    gone = contained_items(docs, table(spark, sf_dir, "benchmark"), doc_col=row).select(row).distinct()
    return docs.join(gone, row, "left_anti").drop(row)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1,024 ids."""
    return pack(docs, public_encoder())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Compression lengths, fitted thresholds and tokenisers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

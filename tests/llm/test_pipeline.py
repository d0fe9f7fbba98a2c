"""The pipeline: its stages keep what they must, and its result is a packing of what is left."""

import corpus_pipeline
from pyspark.sql import functions as F

from textguard.llm.common import fold_of
from textguard.llm.decontaminate import contained_items
from textguard.llm.quality_rules import fit_quality
from textguard.llm.toxicity import fit_toxicity

from .helpers import messy, prose
from .test_near import brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_on_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxic, quality, near, leaks, packing = (f for _, f in corpus_pipeline.STAGES)
    first = toxic(spark, docs, SF)
    model = fit_toxicity(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    assert ids(first) == sorted(r.doc_id for r in docs.collect() if model.score(r.text) < 0.5) and first.columns == docs.columns
    second = quality(spark, docs, SF)
    rules = fit_quality(docs, labels)
    assert ids(second) == ids(docs.where(rules.kept(rules.columns(F.col("text"))))) and second.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    third = near(spark, docs, SF)
    assert ids(third) == sorted(r[0] for r in brute(rows, width=5) if r[3]) and third.columns == docs.columns
    fourth = leaks(spark, docs, SF)
    gone = set(ids(contained_items(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))))
    assert gone and ids(fourth) == [i for i in ids(docs) if i not in gone] and fourth.columns == docs.columns


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, corpus_pipeline.run(spark, SF).collect(), 1024)


def test_messy_rows_pass_the_stages(spark):
    rows = [(1, None), (None, None), (None, "x y"), (7, prose(7, 60)), (7, prose(7, 60)), (8, prose(7, 60)), (9, "")]
    docs = messy(spark, rows)
    toxic, quality, near, leaks, _ = (f for _, f in corpus_pipeline.STAGES)
    assert toxic(spark, docs, SF).count() == len(rows)
    assert quality(spark, docs, SF).columns == docs.columns
    kept = near(spark, docs, SF)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "7", "9", "None", "None"] and kept.columns == docs.columns
    assert leaks(spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_decontamination_judges_every_row_by_itself(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    item = max((t for t in items if t), key=lambda t: len(t.split()))
    words = item.split()
    half = len(words) // 2 + 2
    parts = [" ".join(words[:half]), " ".join(words[half - 4 :])]  # only together do they hold the item
    rows = [(None, item), (None, prose(7, 60)), (None, None), (7, item), (7, prose(8, 60)), (8, parts[0]), (8, parts[1]), (9, item), (10, prose(9, 60))]
    docs = messy(spark, rows)
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (r for r in rows if r[1] != item)))

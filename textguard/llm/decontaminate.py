"""Benchmark decontamination: which documents contain which short test items.

Item sets are distinct five-word shingles (an item of fewer words is one shingle of its own width).
An item of q shingles counts as contained if a document has at least ceil(0.8 q) of them. Items are
partitioned by set size: the size fixes how many shingles may be missing, and with it the length of
the item's MinHash sketch, q - ceil(0.8 q) + 1 smallest hashes. A document that contains the item
cannot miss all of them, so a hit on the sketch is a necessary condition and no leak is lost, however long
the document. Candidates are then verified on the shingles themselves, not on hashes.

Documents stream through a hash join with the sketches, which Spark broadcasts while the stored sketch
table is under its broadcast threshold and shuffles (with skew splitting) beyond it. Only documents with
a sketch hit are read a second time.

Defined results: null or empty items and texts have no shingles and match nothing; rows that share a
document id are one document, rows that share an item id are one item; a null id is an id of its own;
an empty table gives no rows; other input columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, stored, words


def _shingle_rows(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """Explode the array column ``w`` into rows of ``width`` consecutive words (column ``shingle``)."""
    cols = [F.col("w")] + [F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))) for k in range(1, width)]
    rows = df.where(F.size("w") >= width).select(*keep, F.explode(F.arrays_zip(*[c.alias(f"w{k}") for k, c in enumerate(cols)])).alias("s"))
    return rows.where(F.col(f"s.w{width - 1}").isNotNull()).select(*keep, F.concat_ws(" ", *[F.col(f"s.w{k}") for k in range(width)]).alias("shingle"))


def item_shingles(items: DataFrame, item_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """item, shingle, width, q, need, sketch (is it one of the item's smallest hashes?)."""
    w = items.select(F.col(item_col).alias("item"), words(ascii_lower(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    sets = None
    for width in range(1, n + 1):
        own = w.where(F.size("w") >= n) if width == n else w.where(F.size("w") == width)
        rows = _shingle_rows(own, width, "item").select("item", "shingle", F.lit(width).alias("width"))
        sets = rows if sets is None else sets.unionByName(rows)
    grouped = sets.distinct().groupBy("item").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("shingle").alias("h"), "shingle", "width"))).alias("all"))
    q = F.size("all")
    need = F.ceil(q * percent / F.lit(100.0) - 1e-9).cast("int")
    sized = grouped.select("item", "all", q.alias("q"), need.alias("need"))
    return sized.select("item", "q", "need", F.posexplode("all").alias("place", "s")).select(
        "item", "q", "need", "s.h", "s.shingle", "s.width", (F.col("place") <= F.col("q") - F.col("need")).alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
                    item_text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per (document, item) leak: doc id, item id, n_item, n_shared (distinct shingles)."""
    index = stored(item_shingles(items, item_col, item_text_col, n, percent), "item-shingles")
    widths = sorted(r["width"] for r in index.select("width").distinct().collect())  # n rows at most
    texts = docs.select(F.col(doc_col).alias("doc"), words(ascii_lower(F.col(text_col))).alias("w"))
    sketches = index.where("sketch").select("h", "item")
    hits = None
    for width in widths:
        found = _shingle_rows(texts, width, "doc").select("doc", F.xxhash64("shingle").alias("h")).join(sketches, "h").select("doc", "item")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:  # no item has a word
        schema = T.StructType([T.StructField(doc_col, docs.schema[doc_col].dataType), T.StructField(item_col, items.schema[item_col].dataType),
                               T.StructField("n_item", T.IntegerType()), T.StructField("n_shared", T.LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    candidates = stored(hits.distinct(), "leak-candidates")
    again = texts.join(candidates.select("doc").distinct().withColumnRenamed("doc", "c"), F.col("doc").eqNullSafe(F.col("c")), "left_semi")
    shingles = None
    for width in widths:
        rows = _shingle_rows(again, width, "doc")
        shingles = rows if shingles is None else shingles.unionByName(rows)
    full = index.select(F.col("item").alias("i"), "shingle", "q", "need")
    shared = shingles.join(full, "shingle").select("doc", "i", "q", "need", "shingle").distinct()
    counted = shared.groupBy("doc", "i", "q", "need").agg(F.count("*").alias("n_shared")).where("n_shared >= need")
    kept = counted.join(candidates.select(F.col("doc").alias("d"), "item"), F.col("doc").eqNullSafe(F.col("d")) & F.col("i").eqNullSafe(F.col("item")), "left_semi")
    return kept.select(F.col("doc").alias(doc_col), F.col("i").alias(item_col), F.col("q").alias("n_item"), "n_shared")

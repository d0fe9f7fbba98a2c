"""Quality classifier by importance resampling.

Two hashed n-gram models (target: rows labelled good; raw: all rows) give each document a log importance
weight, the sum of its n-grams' log ratios. A Gumbel noise drawn from a hash of the document is added, and
the k largest keys are a sample without replacement in proportion to the weights.

The k-th key is found by counting keys in ever narrower intervals over the stored scores; no global sort.

Defined results: a null or empty text has weight 0; rows that tie with the k-th key are all kept; repeated
rows get equal keys; without target rows every weight is 0; an empty table gives no rows; other input
columns are not carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .ngrams import BROADCAST_IDS, labelled_rows, log_ratio, lower_tokens, ngram_buckets, ngram_counts

BINS = 4096


def log_weight(ratios: np.ndarray, text: Column) -> Column:
    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        return pd.Series([float(ratios[ngram_buckets(t)].sum(dtype=np.float64)) if (t := lower_tokens(x)) else 0.0 for x in texts], dtype="float64")

    return weigh(text)


def gumbel(seed: int, *cols: Column) -> Column:
    """Gumbel noise from 52 hash bits of the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def kth_largest(keys: DataFrame, col: str, k: int, times: str = "1") -> float:
    """Exact k-th largest value of a double column in which a row stands for ``times`` rows (an SQL expression):
    histogram counts, then the few values of one bin."""
    n_rows = F.coalesce(F.sum(F.expr(times)), F.lit(0))
    low, high, n = keys.agg(F.min(col), F.max(col), n_rows).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    above = 0
    while True:
        here = keys.where(F.col(col).between(low, high))
        width = (high - low) / BINS
        if not width or here.select(col).limit(BINS + 1).count() <= BINS:
            for value, n in here.groupBy(col).agg(n_rows).orderBy(F.desc(col)).collect():
                above += n
                if above >= k:
                    return value
        place = F.least(F.floor((F.col(col) - low) / width), F.lit(BINS - 1))
        bins = here.groupBy(place.alias("place")).agg(n_rows.alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).orderBy(F.desc("place")).collect()
        for row in bins:
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality = 1",
             share: float | None = None, seed: int = 7, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """id, log_weight, gumbel_key, kept for every row. ``share`` of the rows is drawn; by default as many as
    the labels call good. The target model is fitted on all rows that they call good."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.expr(target).isNotNull())
    if share is None:
        good, n = known.agg(F.sum(F.expr(target).cast("long")), F.count("*")).first()
        share = (good or 0) / n if n else 1.0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    _, raw = ngram_counts(rows.withColumn("is_target", F.lit(False)), "text", "is_target")
    good_rows = labelled_rows(docs, id_col, text_col, labels.where(F.expr(target)).select(id_col, F.lit(1).alias("kind")), broadcast_ids)
    ratios = log_ratio(ngram_counts(good_rows.withColumn("is_target", F.lit(True)), "text", "is_target")[0], raw)
    scores = stored(rows.select("id", log_weight(ratios, F.col("text")).alias("log_weight"), F.xxhash64("text").alias("h")), "importance")
    keyed = scores.select("id", "log_weight", (F.col("log_weight") + gumbel(seed, F.col("id"), F.col("h"))).alias("gumbel_key"))
    limit = kth_largest(keyed, "gumbel_key", round(share * scores.count()))
    return keyed.select(F.col("id").alias(id_col), "log_weight", "gumbel_key", (F.col("gumbel_key") >= limit).alias("kept"))

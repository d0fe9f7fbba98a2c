"""Quality rules: base rules on words and repeats, and a hashed n-gram log-likelihood ratio.

The ratio compares a multinomial over trusted rows (all rows labelled good) with one over the whole corpus;
a document's ratio is its mean per n-gram. A document is kept if no base rule fails and its ratio is at or
above a threshold. The threshold comes from all labelled rows: the one that separates good and bad rows best
among those that reject at most ``max_loss`` of the good rows.

Defined results: a null text has no words and fails the base rules; rows are judged one by one, repeated
ids and rows alike; without labels of both kinds the threshold keeps everything that passes the base
rules; an empty table gives no rows; extra input columns do not matter (the verdict is an expression).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .ngrams import BROADCAST_IDS, labelled_rows, log_ratio, lower_tokens, ngram_buckets, ngram_counts

WINDOW = 8
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double"
BLANKS, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
_FACTORS = np.random.default_rng(8).integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(tokens: list[bytes]) -> int:
    """Words that lie in a window of eight words which the text has at least twice."""
    n = len(tokens) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.uint64, len(tokens)) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += seq[k : k + n] * _FACTORS[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.zeros(len(tokens) + 1, np.int64)
    starts = np.flatnonzero(twice)
    ends[starts] += 1
    np.add.at(ends, starts + WINDOW, -1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    tokens = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (len(tokens), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(tokens))


@dataclass(frozen=True)
class QualityModel:
    ratios: np.ndarray
    threshold: float
    min_words: int = 20
    max_repeat_percent: int = 30

    def ratio(self, text: str | None) -> float:
        tokens = lower_tokens(text)
        return float(self.ratios[ngram_buckets(tokens)].mean()) if tokens else 0.0

    def columns(self, text: Column) -> Column:
        """Struct of the base counts and the ratio for a text column."""
        model = self

        @F.pandas_udf(BASE)
        def measure(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([(*base_counts(t), model.ratio(t)) for t in texts], columns=[c.split()[0] for c in BASE.split(", ")])

        return measure(text)

    def base_failed(self, s: Column) -> Column:
        return (s["n_words"] < self.min_words) | (100 * s["n_repeat_words"] > self.max_repeat_percent * s["n_words"])

    def kept(self, s: Column) -> Column:
        return ~self.base_failed(s) & (s["ratio"] >= self.threshold)


def best_threshold(good: np.ndarray, bad: np.ndarray, max_loss: float) -> float:
    """Threshold with the highest share of rejected bad rows less lost good rows; minus infinity if nothing is gained."""
    if not len(good) or not len(bad):
        return float("-inf")
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(good, cuts) / len(good)
    gain = np.where(lost <= max_loss, np.searchsorted(bad, cuts) / len(bad) - lost, -1.0)
    best = int(np.argmax(gain))
    below = cuts[best - 1] if best else cuts[0] - 1.0
    return float((below + cuts[best]) / 2) if gain[best] > 0 else float("-inf")


def best_cut(scored: DataFrame, max_loss: float) -> float:
    """``best_threshold`` of a table (kind, ratio) of any size: cuts in ranges of ratios, with counts that start at those of the ranges before."""
    cuts = scored.groupBy("ratio").agg(F.sum("kind").alias("good"), F.sum(1 - F.col("kind")).alias("bad"))
    cuts = stored(cuts.repartitionByRange("ratio").withColumn("part", F.spark_partition_id()), "quality-cuts")
    starts, good, bad, before = [], 0, 0, None
    for r in cuts.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("ratio").alias("last")).orderBy("part").collect():  # a row per range
        starts.append((r["part"], good, bad, before))
        good, bad, before = good + r["good"], bad + r["bad"], r["last"]
    if not good or not bad:
        return float("-inf")
    begun = scored.sparkSession.createDataFrame(starts, "part int, good0 long, bad0 long, before double")
    order = Window.partitionBy("part").orderBy("ratio")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.col(f"{c}0") + F.coalesce(F.sum(c).over(below), F.lit(0))
    rows = cuts.join(F.broadcast(begun), "part").select("ratio", F.coalesce(F.lag("ratio").over(order), "before").alias("below"),
                                                        (so_far("good") / good).alias("lost"), (so_far("bad") / bad).alias("rejected"))
    gain = F.when(F.col("lost") <= max_loss, F.col("rejected") - F.col("lost")).otherwise(-1.0)
    best = rows.withColumn("gain", gain).orderBy(F.desc("gain"), "ratio").first()
    return (best["below"] + best["ratio"]) / 2 if best["gain"] > 0 else float("-inf")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted: str = "quality = 1",
                rejected: str = "quality = 0", max_loss: float = 0.001, broadcast_ids: int = BROADCAST_IDS) -> QualityModel:
    """Fit on ``docs`` with ``labels`` (id, quality): every row, and every label that is ``trusted`` or ``rejected``."""
    good = labels.where(F.expr(trusted)).select(id_col, F.lit(1).alias("kind"))
    bad = labels.where(F.expr(rejected)).select(id_col, F.lit(0).alias("kind"))
    labelled = labelled_rows(docs, id_col, text_col, good.unionByName(bad), broadcast_ids)
    _, raw = ngram_counts(docs.withColumn("trusted", F.lit(False)), text_col, "trusted")
    target, _ = ngram_counts(labelled.where("kind = 1").withColumn("trusted", F.lit(True)), "text", "trusted")
    model = QualityModel(log_ratio(target, raw), float("-inf"))
    bounded_batches(docs.sparkSession)
    # stored, lest Spark move the filter below and measure every text twice, in two Python workers per task
    measured = stored(labelled.select("kind", model.columns(F.col("text")).alias("s")), "quality-measures")
    scored = measured.where(~model.base_failed(F.col("s"))).select("kind", "s.ratio")
    return QualityModel(model.ratios, best_cut(scored, max_loss))

"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

The ordinary dictionary is trained on windows of rows labelled 0. The toxic dictionary holds, ahead of
the same content, segments (words and word beginnings) that rows labelled 1 have much more often than rows
labelled 0; ordinary segments that begin alike stand in both, lest a shared beginning count as toxic. Both are
used as raw content and with the same parameters, so that a window's two compressed
lengths differ only by what the toxic segments save (trained on toxic text as it stands, zstandard's own
choice of content is ordinary prose for the most part, and the difference is noise). Every window of the whole text
is compressed with both; savings above the noise that ordinary windows show feed a three-feature logistic
calibration.

Labels are read for a bounded sample (``sample_rows`` ids of either label, in hash order); segments are
counted in Spark and only the strongest ``max_segments`` reach the driver, as do ``max_windows`` windows.

Defined results: a null or empty text saves nothing and gets the lowest score; without labels of both kinds
every score is 0; repeated rows get equal scores; an empty table gives no rows; extra columns do not matter
(the score is an expression over the text alone).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .ngrams import labelled_sample, lower_tokens

WINDOW_WORDS = 12
#: A word beyond this many bytes is compressed in pieces of its own.
WORD_BYTES = 256
#: Fixed for both dictionaries: left to itself, zstandard chooses by the dictionary's size.
PARAMETERS = {"window_log": 17, "chain_log": 16, "hash_log": 15, "search_log": 5, "min_match": 4, "target_length": 64, "strategy": zstandard.STRATEGY_LAZY2}
SEGMENT_BYTES = (4, 8)
MARKS = b".,;:!?\"'()*$%&#|<>"


def windows(text: str | None) -> list[bytes]:
    """Consecutive windows of a text, each between blanks."""
    tokens = lower_tokens(text)
    if any(len(t) > WORD_BYTES for t in tokens):
        tokens = [t[i : i + WORD_BYTES] for t in tokens for i in range(0, len(t), WORD_BYTES)]
    return [b" " + b" ".join(tokens[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(tokens), WINDOW_WORDS)]


def segments(text: str | None) -> set[bytes]:
    """Distinct words and word beginnings, each with the blank before it."""
    least, most = SEGMENT_BYTES
    found = set()
    for token in set(lower_tokens(text)):
        word = token.strip(MARKS)
        if least <= len(word) <= WORD_BYTES:
            found.add(b" " + word + b" ")
            found.update(b" " + word[:k] for k in range(least, min(len(word), most + 1)))
    return found


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    noise: float = 0.0
    weights: tuple[float, ...] = field(default=(-50.0, 0.0, 0.0, 0.0))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @cached_property
    def _pair(self):
        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parameters = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=parameters)

        return compressor(self.ordinary).compress, compressor(self.toxic).compress

    def savings(self, text: str | None) -> list[int]:
        """Bytes that the toxic dictionary saves, window by window."""
        if not self.toxic:
            return []
        plain, toxic = self._pair
        return [len(plain(w)) - len(toxic(w)) for w in windows(text)]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Largest saving, all savings, and savings per window."""
        saved = self.savings(text)
        s = [x - self.noise for x in saved if x > self.noise]
        return float(max(s, default=0.0)), float(np.log1p(sum(s))), sum(s) / max(1, len(saved))

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, (1.0, *self.features(text))))
        return 1 / (1 + exp(-min(max(z, -50.0), 50.0)))

    def column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def toxicity(texts: pd.Series) -> pd.Series:
            return pd.Series([model.score(t) for t in texts], dtype="float64")

        return toxicity(text)


def _segment_counts(sample: DataFrame) -> DataFrame:
    """Toxic and ordinary rows per segment; partial counts leave a task whenever they grow large."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush():
            keys = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["segment", "n0", "n1"])
            for c in counts:
                c.clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(segments(text))
                if len(counts[0]) + len(counts[1]) > 150_000:
                    yield flush()
        yield flush()

    parts = sample.select("text", "toxic").mapInArrow(count, "segment binary, n0 long, n1 long")
    return parts.groupBy("segment").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _toxic_segments(counts: DataFrame, n0: int, n1: int, lift: float, min_share: float, max_segments: int) -> tuple[list[bytes], list[bytes]]:
    """Toxic segments, strongest first, and the ordinary segments that begin like one of them.

    Of a word and its beginnings only the strongest stays, the longest of equals.
    """
    ratio = F.log(((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1)))
    counts = counts.withColumn("ratio", ratio)
    strong = counts.where((F.col("n1") >= max(5, min_share * n1)) & (F.col("ratio") > float(np.log(lift))))
    rows = strong.orderBy(F.desc(F.col("n1") * F.col("ratio")), F.desc(F.length("segment")), "segment").limit(max_segments).collect()
    out: list[bytes] = []
    for s in (bytes(r["segment"]) for r in rows):
        if not any(s.startswith(t.rstrip()) or t.startswith(s.rstrip()) for t in out):
            out.append(s)
    begin = SEGMENT_BYTES[0]
    like = F.hex(F.substring("segment", 1, begin)).isin(sorted({s[:begin].hex().upper() for s in out}))
    plain = counts.where(like & (F.col("n0") >= max(2, 0.002 * n0)) & (F.col("ratio") < float(np.log(lift)) / 2))
    return out, [bytes(r["segment"]) for r in plain.orderBy(F.desc("n0"), "segment").limit(max_segments).collect()]


def _ordinary_content(sample: DataFrame, max_windows: int, dict_bytes: int) -> bytes:
    per_row = F.udf(lambda t: (w := windows(t))[:: max(1, len(w) // 8)], "array<binary>")  # eight windows, spread over the text
    rows = sample.where("toxic = 0").select(F.explode(per_row("text")).alias("w")).orderBy(F.xxhash64("w"), "w").limit(max_windows).collect()
    found = [bytes(r["w"]) for r in rows]
    try:
        return zstandard.train_dictionary(dict_bytes, found).as_bytes()
    except zstandard.ZstdError:  # too few windows to choose from: use them all
        return b"".join(found)[:dict_bytes]


def _calibrate(features: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression, then a shift that puts 0.5 where most sample rows are called right."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - labels) + 1e-2 * w), -5, 5)
    z = x @ w
    cuts = np.unique(z)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    pos, neg = np.sort(z[labels == 1]), np.sort(z[labels == 0])
    errors = np.searchsorted(pos, cuts) + len(neg) - np.searchsorted(neg, cuts)
    w[0] -= cuts[int(np.argmin(errors))]
    return tuple(map(float, w))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000,
                 lift: float = 10.0, min_share: float = 0.025, max_segments: int = 2048, max_windows: int = 8000, dict_bytes: int = 16384) -> ToxicityModel:
    """Fit on ``docs`` with ``labels`` (id, toxic); pass only the labels that may be learnt from."""
    bounded_batches(docs.sparkSession)
    ids = None
    for kind in (0, 1):
        own = labelled_sample(labels, id_col, F.col("toxic") == kind, sample_rows).select(F.col(id_col).alias("sample_id"), F.lit(kind).alias("toxic"))
        ids = own if ids is None else ids.unionByName(own)
    ids = F.broadcast(ids.groupBy("sample_id").agg(F.max("toxic").alias("toxic")))  # 2 * sample_rows rows at most
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("sample_id")).select("text", "toxic")
    sample = stored(sample, "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return ToxicityModel(b"", b"")
    counts = stored(_segment_counts(sample), "toxicity-segments")
    found, alike = _toxic_segments(counts, n[0], n[1], lift, min_share, max_segments)
    ordinary = b"".join(alike) + _ordinary_content(sample, max_windows, dict_bytes)
    model = ToxicityModel(ordinary, b"".join(found) + ordinary)
    quiet = F.udf(lambda t: model.savings(t), "array<int>")
    noise = sample.where("toxic = 0").select(F.explode(quiet("text")).alias("s")).agg(F.percentile_approx("s", 0.999, 10000)).first()[0]
    model = ToxicityModel(model.ordinary, model.toxic, float(max(noise or 0, 0)))
    measured = sample.select("toxic", F.udf(lambda t: model.features(t), "struct<a: double, b: double, c: double>")("text").alias("f")).select("toxic", "f.a", "f.b", "f.c").collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in measured])
    return ToxicityModel(model.ordinary, model.toxic, model.noise, _calibrate(x, np.array([r["toxic"] for r in measured])))

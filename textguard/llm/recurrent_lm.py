"""Language-model scoring with a gated recurrent network.

Vocabulary. Words are counted over all training rows, with one end mark per row. The ``WORDS`` most frequent words
(the end among them) are predicted one by one; every other word, known or not, belongs to one of ``REST`` rest
classes by its last two bytes. The output is factored: a softmax over classes, then, for the frequent words, a
softmax within the class; within a rest class a word has the smoothed share (c + 0.1) / (N_k + 0.1 (V_k + 1)) of
its training count, so any word has a probability. Class and word biases start at the corpus frequencies.

Training. Gated recurrent units, truncated backpropagation, Adam, all in numpy. Every training row is learnt once in
every round, at any size of the corpus. A round has ``LEGS`` legs; a hash of a row tells its leg. A task is one trainer:
it reads its rows once, about ``TRAINER_TOKENS`` tokens at a time, each part from the weights after the part before, in
``STREAMS`` streams side by side, so that a step is a few large products. All start a leg from the same weights, whose
average starts the next leg. So the work grows with the corpus and runs on all executors, where the rows lie; averages
are formed in groups. Tokens learnt are counted, and a round that has not learnt all fails.

Scoring. Documents run side by side through windows of ``SPAN`` steps; the state is carried from window to window,
so a document is scored whole. Counts of words beyond the ``known_words`` most frequent (a bounded table sent to
the tasks) are joined by word; their logarithms enter the model's score and the base score alike.

Defined results: a null or empty text is one end mark; rows are scored one by one, repeated ids and rows alike;
a null id counts as the empty text for the fold; without training rows all counts are 0; an empty table gives no
rows; other input columns are not carried along.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import ceil, log, log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold_of, stored
from .ngrams import lower_tokens
from .resample import kth_largest

H = 16
CLASSES, CLASS_SIZE, REST = 64, 64, 64
WORDS = CLASSES * CLASS_SIZE
START = WORDS + REST
END = b""
SPAN, BACK = 32, 20
STREAMS, PART, CHUNK = 256, 256, 8192
#: Parts of a round; the weights are averaged after each.
LEGS = 2
TRAINER_TOKENS = 300_000
#: A word beyond this many bytes is never in the table of frequent words, which bounds that table.
WORD_BYTES = 48
#: Bytes of text that are scored side by side.
BLOCK_BYTES = 16_000_000


def rest_class(word: bytes) -> int:
    return crc32(word[-2:]) % REST


def tokens_of(text: str | None) -> list[bytes]:
    return [*lower_tokens(text), END]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * x)) - 1


class Network:
    """Weights by name; ids below WORDS are words, below START rest classes, START begins a document."""

    def __init__(self, word_counts: np.ndarray, rest_counts: np.ndarray, seed: int = 6):
        rng = np.random.default_rng(seed)
        mass = np.concatenate([word_counts.reshape(CLASSES, CLASS_SIZE).sum(axis=1), rest_counts]) + 1.0
        within = np.log(word_counts + 0.1).reshape(CLASSES, CLASS_SIZE)
        self.w = {
            "x": rng.normal(0, 0.1, (START + 1, 3 * H)), "zr": rng.normal(0, 0.2, (H, 2 * H)), "c": rng.normal(0, 0.2, (H, H)),
            "b": np.concatenate([np.full(H, -1.0), np.zeros(2 * H)]), "k": rng.normal(0, 0.05, (H, CLASSES + REST)), "kb": np.log(mass / mass.sum()),
            "v": rng.normal(0, 0.05, (CLASSES, H, CLASS_SIZE)), "vb": within - np.log(np.exp(within).sum(axis=1, keepdims=True)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def step(self, x: np.ndarray, h: np.ndarray):
        gx = self.w["x"][x]
        gx += self.w["b"]
        zr = _sigmoid(gx[:, : 2 * H] + h @ self.w["zr"])
        z, r = zr[:, :H], zr[:, H:]
        c = _tanh(gx[:, 2 * H :] + (r * h) @ self.w["c"])
        return h + z * (c - h), z, r, c

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of class and, for frequent words, word in class."""
        group = np.where(target < WORDS, target // CLASS_SIZE, target - WORDS + CLASSES).astype(np.uint8)
        one = np.ones((len(h), 1), h.dtype)
        h = np.concatenate([h, one], axis=1)  # so that the products hold the biases
        logits = h @ np.concatenate([self.w["k"], self.w["kb"][None]])
        out = logits[np.arange(len(h)), group]
        out -= np.log(np.exp(logits, out=logits).sum(axis=1))
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(CLASSES + 1))
        v = np.concatenate([self.w["v"], self.w["vb"][:, None]], axis=1)
        for g in range(CLASSES):
            at = order[bounds[g] : bounds[g + 1]]
            if len(at):
                logits = h[at] @ v[g]
                own = logits[np.arange(len(at)), target[at] - g * CLASS_SIZE]
                out[at] += own - np.log(np.exp(logits, out=logits).sum(axis=1))
        return out

    def train(self, documents: list[np.ndarray], rate: float) -> None:
        """One pass over the documents, dealt to parallel streams; gradients reach back BACK steps.

        A long document is dealt in parts, each from a zero state, lest its end be all that is learnt last.
        """
        if not documents:
            return
        parts = [(d, a) for d in documents for a in range(0, len(d), PART)]
        load, streams = np.zeros(STREAMS, np.int64), [[] for _ in range(STREAMS)]
        for j in np.random.default_rng(len(parts)).permutation(len(parts)):
            d, a = parts[j]
            k = int(load.argmin())
            streams[k].append((d, a))
            load[k] += min(PART, len(d) - a)
        length = int(load.max())
        inputs, targets = np.full((STREAMS, length), START, np.int32), np.full((STREAMS, length), -1, np.int32)
        fresh = np.zeros((STREAMS, length), bool)
        for k, ps in enumerate(streams):
            at = 0
            for d, a in ps:
                n = min(PART, len(d) - a)
                targets[k, at : at + n] = d[a : a + n]
                inputs[k, at + 1 : at + n] = d[a : a + n - 1]
                inputs[k, at] = d[a - 1] if a else START
                fresh[k, at] = True
                at += n
        h = np.zeros((STREAMS, H), np.float32)
        if not hasattr(self, "turn"):  # moments and their age last as long as the trainer
            self.m, self.s = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
            self.turn = 0
        for t0 in range(0, length, BACK):
            x, y, new = inputs[:, t0 : t0 + BACK], targets[:, t0 : t0 + BACK], fresh[:, t0 : t0 + BACK]
            g, h = self._gradients(x, y, new, h)
            self.turn += 1
            for k, v in self.w.items():  # of the input table only the rows that this span has used
                at, d = g[k]
                m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
                s = self.s[k][at] = 0.99 * self.s[k][at] + 0.01 * d * d
                v[at] -= (rate / (1 - 0.9**self.turn)) * m / (np.sqrt(s / (1 - 0.99**self.turn)) + 1e-6)

    def _gradients(self, x: np.ndarray, y: np.ndarray, new: np.ndarray, h: np.ndarray):
        """Rows and gradients of each table (mean loss of the span's targets), and the state after it."""
        span, past = x.shape[1], []
        states = np.empty((span, len(h), H), np.float32)
        for t in range(span):
            h0 = np.where(new[:, t, None], np.float32(0), h)
            h, z, r, c = self.step(x[:, t], h0)
            past.append((h0, z, r, c))
            states[t] = h
        g = {k: np.zeros_like(v) for k, v in self.w.items() if k != "x"}
        target = y.T.reshape(-1)
        flat, dflat = states.reshape(-1, H), np.zeros((span * len(h), H), np.float32)
        group = np.where(target < WORDS, target // CLASS_SIZE, target - WORDS + CLASSES).astype(np.int16)
        ok = np.argsort(group, kind="stable")[np.count_nonzero(target < 0) :]  # by class; places without a target came first
        if len(ok):
            hs, tg, group, scale = flat[ok], target[ok], group[ok], np.float32(1 / len(ok))
            p = hs @ self.w["k"]
            p += self.w["kb"]
            np.exp(p, out=p)
            p *= scale / p.sum(axis=1, keepdims=True)
            rows = np.arange(len(ok))
            p[rows, group] -= scale
            g["k"], g["kb"] = hs.T @ p, p.sum(axis=0)
            d = p @ self.w["k"].T
            bounds = np.searchsorted(group, np.arange(CLASSES + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                at = slice(bounds[k], bounds[k + 1])
                q = hs[at] @ self.w["v"][k]
                q += self.w["vb"][k]
                np.exp(q, out=q)
                q *= scale / q.sum(axis=1, keepdims=True)
                q[rows[: len(q)], tg[at] - k * CLASS_SIZE] -= scale
                g["v"][k], g["vb"][k] = hs[at].T @ q, q.sum(axis=0)
                d[at] += q @ self.w["v"][k].T
            dflat[ok] = d
        dstates, dh = dflat.reshape(span, -1, H), np.zeros_like(h)
        dx = np.empty((span, len(h), 3 * H), np.float32)
        for t in range(span - 1, -1, -1):
            h0, z, r, c = past[t]
            dh = dh + dstates[t]
            dc = dh * z * (1 - c * c)
            drh = dc @ self.w["c"].T
            dx[t, :, :H] = dh * (c - h0) * z * (1 - z)
            dx[t, :, H : 2 * H] = drh * h0 * r * (1 - r)
            dx[t, :, 2 * H :] = dc
            dzr = dx[t, :, : 2 * H]
            g["zr"] += h0.T @ dzr
            g["c"] += (r * h0).T @ dc
            dh = dh * (1 - z) + drh * r + dzr @ self.w["zr"].T
            dh[new[:, t]] = 0
        dx = dx.reshape(-1, 3 * H)
        g["b"] = dx.sum(axis=0)
        ids = x.T.reshape(-1).astype(np.int16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        parts = {**{k: (slice(None), v) for k, v in g.items()}, "x": (ids[first], np.add.reduceat(dx[order], first))}
        return {k: (at, np.clip(v, -1, 1)) for k, (at, v) in parts.items()}, h

    def document_scores(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural-log likelihood of every document, all run side by side, longest first."""
        order = np.argsort([-len(d) for d in documents], kind="stable")
        lengths = np.array([len(documents[i]) for i in order])
        offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        target = np.concatenate([documents[i] for i in order])
        inputs = np.empty_like(target)
        inputs[1:] = target[:-1]
        inputs[offsets] = START
        total, h = np.zeros(len(documents)), np.zeros((len(documents), H), np.float32)
        for t0 in range(0, int(lengths[0]), SPAN):
            alive = [int(np.searchsorted(-lengths, -(t0 + t), "left")) for t in range(min(SPAN, int(lengths[0]) - t0))]
            states, where = [], []
            for t, n in enumerate(alive):  # the first n documents are longer than t0 + t
                at = offsets[:n] + (t0 + t)
                h[:n] = self.step(inputs[at], h[:n])[0]
                states.append(h[:n].copy())
                where.append(at)
            states, where = np.concatenate(states), np.concatenate(where)
            who = np.concatenate([np.arange(n) for n in alive])
            for a in range(0, len(where), CHUNK):
                part = slice(a, a + CHUNK)
                total += np.bincount(who[part], self.log_probability(states[part], target[where[part]]), len(total))
        out = np.empty(len(documents))
        out[order] = total
        return out


@dataclass
class Vocabulary:
    """Frequent words by rank, each rank's network id and log10(c + 0.1); rest-class sums, N and V."""

    rank: dict[bytes, int]
    network_id: np.ndarray  # by rank; ids from WORDS on are rest classes
    log_count: np.ndarray
    total: int
    distinct: int
    rest_total: np.ndarray
    rest_distinct: np.ndarray

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Network ids, ranks (-1 beyond the table), and the words beyond the table."""
        ranks = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))
        ids = self.network_id[ranks]
        beyond = np.flatnonzero(ranks < 0)
        rare = [words[i] for i in beyond]
        ids[beyond] = np.fromiter(map(rest_class, rare), np.int32, len(rare)) + WORDS
        return ids, ranks, rare


def _training_counts(docs: DataFrame) -> DataFrame:
    """word, c, k (rest class) over the training rows; counters leave a task whenever they grow large."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()

        def flush():
            keys = list(words)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words.values(), pa.int64()), pa.array(map(rest_class, keys), pa.int32())], names=["word", "c", "k"])
            words.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(tokens_of(text))
                if len(words) > 150_000:
                    yield flush()
        yield flush()

    parts = docs.where("not held_out").select("text").mapInArrow(count, "word binary, c long, k int")
    return parts.groupBy("word", "k").agg(F.sum("c").alias("c"))


def _vocabulary(counts: DataFrame, known_words: int) -> tuple[Vocabulary, np.ndarray]:
    short = counts.where(F.length("word") <= WORD_BYTES).select("word", F.col("c").cast("double").alias("c"), "k")
    times = stored(short.groupBy("c").agg(F.count("*").alias("words")), "lm-count-counts")
    if (times.agg(F.sum("words")).first()[0] or 0) > known_words:  # words that tie with the limit stay out: known_words rows at most
        short = short.where(F.col("c") > kth_largest(times, "c", known_words, "words"))
    top = sorted(short.collect(), key=lambda r: (-r["c"], r["word"]))
    sums = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # REST rows
    rest_total, rest_distinct = (np.array([sums.get(k, (0, 0))[i] for k in range(REST)], float) for i in (0, 1))
    word_counts, network_id = np.zeros(WORDS), np.zeros(max(1, len(top)), np.int32)
    for i, r in enumerate(top):
        network_id[i] = i if i < WORDS else WORDS + r["k"]
        if i < WORDS:
            word_counts[i] = r["c"]
            rest_total[r["k"]] -= r["c"]
            rest_distinct[r["k"]] -= 1
    rank = {bytes(r["word"]): i for i, r in enumerate(top)}
    log_count = np.log10(np.array([r["c"] for r in top] or [0.0]) + 0.1)
    total, distinct = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    return Vocabulary(rank, network_id, log_count, total, distinct, rest_total, rest_distinct), word_counts


def _average(blobs: DataFrame) -> tuple[dict[str, np.ndarray], int] | None:
    """Mean of the trainers' weights, by tokens, and the tokens; groups of 16 or so at a time, so no task holds many sets of weights."""
    def merge(rows: pa.Table) -> pa.Table:
        total, n = {}, 0
        for blob, tokens in zip(rows.column("blob").to_pylist(), rows.column("n").to_pylist()):
            for k, v in pickle.loads(blob).items():
                total[k] = total.get(k, 0) + v * np.float64(tokens)
            n += tokens
        mean = {k: (v / n).astype(np.float32) for k, v in total.items()}
        return pa.table({"blob": pa.array([pickle.dumps(mean)], pa.binary()), "n": pa.array([n], pa.int64())})

    blobs = stored(blobs, "lm-weights")
    while (left := blobs.count()) > 1:
        groups = blobs.withColumn("g", F.pmod(F.xxhash64("blob"), F.lit(ceil(left / 16))))
        blobs = stored(groups.groupBy("g").applyInArrow(lambda rows: merge(rows), "blob binary, n long"), "lm-weights")
    row = blobs.first()
    return (pickle.loads(row["blob"]), row["n"]) if row else None


def _fit(docs: DataFrame, vocabulary: Vocabulary, shared, network: Network, rounds: int, rate: float) -> Network:
    rows = docs.where("not held_out").select("text", F.pmod(F.xxhash64("id", "text"), F.lit(LEGS)).alias("leg"))
    trainers = max(1, ceil(vocabulary.total / LEGS / TRAINER_TOKENS))
    for turn in range(rounds):
        tokens = 0
        for leg in range(LEGS):
            weights = docs.sparkSession.sparkContext.broadcast(network.w)
            slower = rate / (1 + LEGS * turn + leg) ** 0.5

            def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = Network.__new__(Network)
                own.w = {k: v.copy() for k, v in weights.value.items()}
                documents, size, learnt = [], 0, 0
                for batch in batches:
                    for text in batch.column(0).to_pylist():
                        documents.append(shared.value.read(tokens_of(text))[0])
                        size += len(documents[-1])
                        if size >= TRAINER_TOKENS:
                            own.train(documents, slower)
                            documents, size, learnt = [], 0, learnt + size
                own.train(documents, slower)
                if learnt + size:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own.w)], pa.binary()), pa.array([learnt + size], pa.int64())], names=["blob", "n"])

            learnt = _average(rows.where(F.col("leg") == leg).select("text").coalesce(trainers).mapInArrow(train, "blob binary, n long"))
            if learnt is not None:  # a leg may have no rows
                network.w, tokens = learnt[0], tokens + learnt[1]
        if tokens != vocabulary.total:
            raise RuntimeError(f"round {turn} learnt {tokens} of {vocabulary.total} training tokens")
    return network


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10,
                    rounds: int = 1, rate: float = 0.05, known_words: int = 131_072) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for every row."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold_of(F.col(id_col), folds) == 0).alias("held_out"))
    counts = stored(_training_counts(docs), "lm-counts")
    vocabulary, word_counts = _vocabulary(counts, known_words)
    shared = spark.sparkContext.broadcast(vocabulary)  # known_words words of WORD_BYTES bytes at most
    network = _fit(docs, vocabulary, shared, Network(word_counts, vocabulary.rest_total), rounds, rate)
    weights = spark.sparkContext.broadcast(network.w)
    base_log = log10(vocabulary.total + 0.1 * (vocabulary.distinct + 1))
    rest_log = np.log10(vocabulary.rest_total + 0.1 * (vocabulary.rest_distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.__new__(Network)
        net.w = weights.value
        words = shared.value

        def block(rows):
            documents, tails, logs = [], [], np.empty(len(rows))
            for j, (_, _, text) in enumerate(rows):
                own, ranks, rare = words.read(tokens_of(text))
                documents.append(own)
                tails.append(rare)
                # the network's share of a rest word is its class; base and model add log10(c + 0.1) of rare words later
                logs[j] = words.log_count[ranks[ranks >= 0]].sum()
            frequent = np.array([words.log_count[d[d < WORDS]].sum() for d in documents])  # the first ranks are the network's ids
            rest = np.array([rest_log[d[d >= WORDS] - WORDS].sum() for d in documents])
            model = net.document_scores(documents) / log(10)
            n = np.array([len(d) for d in documents])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows]), pa.array(n), pa.array(n - [len(t) for t in tails]), pa.array(logs - n * base_log),
                 pa.array(model + logs - frequent - rest), pa.array(tails, pa.list_(pa.binary()))],
                names=["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

        kind, rows, size = None, [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                size += len(row[2] or "")
                if size > BLOCK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
        if rows:
            yield block(rows)

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    scored = stored(docs.select("id", "held_out", "text").mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.select("word", "c"), "word", "left")
    found = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"), F.count("c").alias("seen"))
    out = scored.drop("rare").join(found, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))

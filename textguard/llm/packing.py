"""Packing token sequences: non-negative least squares over window fillings.

A document's tokens are cut into full windows, each a sequence of its own, and a tail. The histogram of tail
lengths has at most ``window - 1`` entries. Shallow combinations of two or three lengths that fill a window exactly
are enumerated, their repeat counts solved by non-negative least squares against the histogram and rounded,
most used first, within what the histogram has left. What remains is packed greedily, longest first with the
longest that still fits; a sequence that this would leave more than ``slack`` tokens short is not made, its
longest tail goes to a line of tails that is cut every ``window`` tokens instead. So padding is at most
``slack`` tokens in a greedy sequence and one partial sequence at the end of the line.

Every tail has a rank among the tails of its length: its rank within its task (counted while the tokens are
stored, and stored with them) plus the number in earlier tasks. Rank and plan give its place, row by row; the
driver sees the histogram and the plan only.

Defined results: a null or empty text is one end id; rows are packed one by one, repeated ids and rows alike; an
empty table gives no rows; other input columns are not carried along.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

END_ID = 0


class Encoder:
    """Byte-level BPE by the public vocabulary file (base64 token and rank per line); ids equal the json file's.

    ``added`` are the json file's added tokens: their literals are cut out of a text before the merges.
    """

    _loaded: dict[tuple, object] = {}

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        self.key = (ranks_path, pattern, tuple((added or {}).items()))

    def encode(self, text: str) -> list[int]:
        bpe = self._loaded.get(self.key)
        if bpe is None:
            import tiktoken

            with open(self.key[0], "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            bpe = self._loaded[self.key] = tiktoken.Encoding("public", pat_str=self.key[1], mergeable_ranks=ranks, special_tokens=dict(self.key[2]))
        return bpe.encode(text, allowed_special="all")


def fillings(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of present lengths that add up to the window; c is 0 in pairs."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    rows = []
    for a in map(int, lengths):
        rest = window - a
        b = np.arange((rest + 1) // 2, min(a, rest) + 1)
        c = rest - b
        ok = present[b] & (present[c] | (c == 0)) & (b > 0)
        rows.append(np.column_stack([np.full(ok.sum(), a), b[ok], c[ok]]))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """min |A x - h|^2 over x >= 0 by accelerated projected gradients; column j of A counts the lengths of combo j."""
    def forward(x):
        return sum(np.bincount(combos[:, k], x, len(histogram)) for k in range(3)) * nonzero

    def back(r):
        return (r * nonzero)[combos].sum(axis=1)

    nonzero = np.ones(len(histogram))
    nonzero[0] = 0
    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(forward(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        step = np.maximum(0, y - back(forward(y) - histogram) / (1.05 * size))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = step + (before - 1) / t * (step - x)
        x = step
    return x


@dataclass
class Plan:
    """For each length: rank ranges with first sequence, uses per sequence and offsets; then the cut line."""

    window: int
    runs: dict[int, tuple[np.ndarray, list[tuple[int, tuple[int, ...]]]]]
    line: dict[int, tuple[int, int]]  # length: (first rank on the line, token position of that rank)
    line_sequence: int
    sequences: int

    def places(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of the tail with this rank."""
        first_rank, position = self.line.get(length, (1 << 62, 0))
        if rank >= first_rank:
            at, out, left = position + (rank - first_rank) * length, [], length
            while left:
                take = min(left, self.window - at % self.window)
                out.append((self.line_sequence + at // self.window, at % self.window, take))
                at, left = at + take, left - take
            return out
        starts, runs = self.runs[length]
        k = int(np.searchsorted(starts, rank, "right")) - 1
        sequence, offsets = runs[k]
        i = rank - int(starts[k])
        return [(sequence + i // len(offsets), offsets[i % len(offsets)], length)]


def make_plan(histogram: np.ndarray, window: int, slack: int = 8) -> Plan:
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[tuple[int, ...], int]] = []
    combos = fillings(np.flatnonzero(left), window)
    if len(combos):
        x = solve_counts(combos, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            parts = tuple(int(p) for p in combos[j] if p)
            n = min(int(round(x[j])), *(int(left[p]) // m for p, m in Counter(parts).items()))
            if n > 0:
                made.append((parts, n))
                np.subtract.at(left, list(parts), n)
    on_line = np.zeros_like(left)
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            parts, space = [longest], window - longest
            take = left.copy()
            take[longest] -= 1
            while space:
                fit = np.flatnonzero(take[1 : space + 1])
                if not len(fit):
                    break
                p = int(fit[-1]) + 1
                parts.append(p)
                take[p] -= 1
                space -= p
            if space > slack:
                on_line[longest] += left[longest]
                left[longest] = 0
                break
            n = min(int(left[p]) // m for p, m in Counter(parts).items())
            made.append((tuple(parts), n))
            np.subtract.at(left, parts, n)
    used, runs, sequence = Counter(), {}, 0
    for parts, n in made:
        offsets: dict[int, list[int]] = {}
        at = 0
        for p in parts:
            offsets.setdefault(p, []).append(at)
            at += p
        for p, places in offsets.items():
            starts, entries = runs.setdefault(p, ([], []))
            starts.append(used[p])
            entries.append((sequence, tuple(places)))
            used[p] += n * len(places)
        sequence += n
    line, position = {}, 0
    for length in map(int, np.flatnonzero(on_line)):
        line[length] = (used[length], position)
        position += length * int(on_line[length])
    return Plan(window, {p: (np.array(s), e) for p, (s, e) in runs.items()}, line, sequence, sequence - (-position // window))


def _tokens(docs: DataFrame, encoder, window: int) -> DataFrame:
    """id, ids, tail, tail_rank and full_rank (ranks within the task), part (the task's number, as data)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, full = Counter(), 0
        for batch in batches:
            ids, tails, tail_ranks, full_ranks = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = np.array([*encoder.encode(text or ""), END_ID], np.int32)
                tail = len(own) % window
                ids.append(own)
                tails.append(tail)
                tail_ranks.append(seen[tail])
                full_ranks.append(full)
                seen[tail] += 1
                full += len(own) // window
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(tails, pa.int32()), pa.array(tail_ranks, pa.int64()), pa.array(full_ranks, pa.int64())],
                names=["id", "ids", "tail", "tail_rank", "full_rank"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(encode, f"id {kind}, ids array<int>, tail int, tail_rank long, full_rank long").withColumn("part", F.spark_partition_id())


def _earlier(rows: DataFrame, window: int) -> DataFrame:
    """part, before: for each tail length (entry 0: for full windows) the count in parts with a smaller number."""
    counts = rows.where("tail > 0").groupBy("part", "tail").agg(F.count("*").alias("n"))
    full = rows.groupBy("part").agg(F.sum(F.floor(F.size("ids") / window)).alias("n")).select("part", F.lit(0).alias("tail"), "n")
    from pyspark.sql import Window

    order = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    run = counts.unionByName(full).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return run.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("tail", "before"))).alias("before"))  # window entries at most


def pack(docs: DataFrame, encoder, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, slack: int = 8) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    bounded_batches(docs.sparkSession, 256)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(_tokens(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), encoder, window), "tokens")
    histogram = np.zeros(window + 1, np.int64)
    for r in rows.groupBy("tail").count().collect():  # window rows at most
        histogram[r["tail"]] = r["count"]
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, window, slack))  # bounded by the number of fillings
    earlier = stored(_earlier(rows, window), "earlier")
    placed = rows.join(earlier, "part").select(
        "id", "ids", "tail", (F.col("tail_rank") + F.coalesce(F.element_at("before", F.col("tail")), F.lit(0))).alias("tail_rank"),
        (F.col("full_rank") + F.element_at("before", F.lit(0))).alias("full_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            flat = batch.column(1).values.to_numpy().astype("<u4")
            ends = batch.column(1).offsets.to_numpy()
            who, start, length, ids, total, sequence, offset = ([] for _ in range(7))
            tails, tail_ranks, full_ranks = (batch.column(c).to_numpy() for c in (2, 3, 4))
            for i in range(batch.num_rows):
                own = flat[ends[i] : ends[i + 1]]
                full = len(own) // window
                pieces = [(p.sequences + int(full_ranks[i]) + k, 0, window) for k in range(full)]
                if tails[i]:
                    pieces += p.places(int(tails[i]), int(tail_ranks[i]))
                at = 0
                for s, o, n in pieces:
                    who.append(i)
                    start.append(at)
                    length.append(n)
                    ids.append(own[at : at + n].tobytes())
                    total.append(len(own))
                    sequence.append(s)
                    offset.append(o)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    out = placed.mapInArrow(place, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out

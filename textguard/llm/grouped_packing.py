"""Best-fit packing by linear grouping: whole documents into as few sequences as possible.

Only documents longer than the window are cut, into full windows (a sequence each) and a last piece. The histogram
of last pieces has at most ``window - 1`` lengths, and the plan is made on it alone:

1. Lengths above ``large`` of the window, longest first, form groups of about equal numbers of documents (a length
   stays in one group); every length is rounded up to the longest of its group.
2. Configurations of the few rounded lengths that fit a sequence are optimised by column generation: the simplex
   basis prices lengths, an unbounded knapsack over the window finds the configuration worth most.
3. Whole repeats of each configuration become sequences, their places are taken by actual documents of the groups,
   so that every sequence has the space of the configuration and what its documents are shorter than rounded.
4. What is left, longest first, goes to the sequence with the least space that holds it, or opens a new one.

Equal sequences are planned as one run of (count, space), so the plan has a bounded number of runs however many
documents there are. A document's rank among the last pieces of its length (rank within its task plus the number in
earlier tasks) gives its run, and with it sequence and offset, row by row.

Defined results: a null or empty text is one end id; rows are packed one by one, repeated ids and rows alike; an
empty table gives no rows; other input columns are not carried along.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .packing import END_ID, _earlier

#: Words that one worker keeps with their ids; when they are more, it forgets all and begins anew.
CACHED_WORDS, CACHED_BYTES = 800_000, 64
#: Chunks of printable ASCII and Latin-1 letters split into words as the tokenizer's own pattern does, once they are lower-cased.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+\Z")
PLAIN_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordEncoder:
    """Ids of a word-end BPE json file. ASCII white space always separates its words, so chunks between it are encoded once.

    Plain chunks are merged over the file's own vocabulary with the word end as one more byte, any other chunk is
    encoded by the json file's tokenizer itself; tests hold the ids equal.
    """

    _loaded: dict[str, tuple] = {}

    def __init__(self, path: str):
        self.path = path

    def _load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import tiktoken
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {}
        for token, rank in vocabulary.items():
            word = token.removesuffix("</w>")
            if word and all(c in byte_of for c in word):
                ranks[bytes(byte_of[c] for c in word) + b"\xff" * (word != token)] = rank
        merges = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks={k: v for k, v in ranks.items() if k != b"\xff"}, special_tokens={})
        return Tokenizer.from_file(self.path), merges._core_bpe.encode_single_piece, {}

    def encode(self, text: str) -> np.ndarray:
        if self.path not in self._loaded:
            self._loaded[self.path] = self._load()
        tokenizer, merge, known = self._loaded[self.path]
        chunks = text.encode("utf-8", "replace").split()
        new = set(chunks).difference(known)
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = set(chunks)
        long, other = {}, []
        for chunk in new:
            plain = chunk.decode()
            if PLAIN.match(plain) and "<|" not in plain:
                (known if len(chunk) <= CACHED_BYTES else long)[chunk] = array("i", [i for w in PLAIN_WORDS.findall(plain.lower()) for i in merge(w.encode() + b"\xff")]).tobytes()
            else:
                other.append(chunk)
        if other:
            for chunk, found in zip(other, tokenizer.encode_batch_fast([c.decode() for c in other], add_special_tokens=False)):
                (known if len(chunk) <= CACHED_BYTES else long)[chunk] = array("i", found.ids).tobytes()
        look = known.__getitem__ if not long else lambda c: long[c] if c in long else known[c]
        return np.frombuffer(b"".join(map(look, chunks)), np.int32)


def best_configuration(sizes: np.ndarray, prices: np.ndarray, window: int) -> tuple[float, np.ndarray]:
    """Worth and counts per size of the multiset of sizes that fits the window and is worth most."""
    worth, last = np.zeros(window + 1), np.full(window + 1, -1)
    for j in np.flatnonzero(prices > 1e-12):
        size = int(sizes[j])
        for _ in range(window // size):
            more = worth[:-size] + prices[j]
            better = more > worth[size:] + 1e-12
            if not better.any():
                break
            worth[size:][better] = more[better]
            last[size:][better] = j
    counts, at = np.zeros(len(sizes)), window
    while last[at] >= 0:
        counts[last[at]] += 1
        at -= int(sizes[last[at]])
    return float(counts @ prices), counts


def optimise(sizes: np.ndarray, need: np.ndarray, window: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Configurations (counts per size) with whole repeats, from the least number of sequences that holds ``need``."""
    basis = np.diag((window // sizes).astype(float))
    repeats = need / np.diag(basis)
    for _ in range(rounds):  # each round's basis is feasible, so stopping early costs sequences, not rows
        worth, counts = best_configuration(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), window)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, counts)
        ratio = np.divide(repeats, step, out=np.full(len(step), np.inf), where=step > 1e-10)
        leaves = int(np.argmin(ratio))
        amount = ratio[leaves]
        repeats = np.maximum(repeats - amount * step, 0)
        repeats[leaves], basis[:, leaves] = amount, counts
    order = np.argsort(-repeats, kind="stable")
    return [(basis[:, c].round().astype(int), int(repeats[c] + 1e-9)) for c in order if repeats[c] >= 1 - 1e-9]


@dataclass
class Plan:
    """For each length: first ranks of its runs, and each run's first sequence and offset."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int

    def place(self, length: int, rank: int) -> tuple[int, int]:
        starts, sequences, offsets = self.runs[length]
        k = int(np.searchsorted(starts, rank, "right")) - 1
        return int(sequences[k]) + rank - int(starts[k]), int(offsets[k])


def make_plan(histogram: np.ndarray, window: int, large: float = 1 / 3, groups: int = 256) -> Plan:
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used: Counter = Counter()
    runs: dict[int, list[tuple[int, int, int]]] = {}
    spaces: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # by space left: runs of (first sequence, count)
    is_open = np.zeros(window + 1, bool)
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.setdefault(length, []).append((used[length], sequence, offset))
        used[length] += n
        left[length] -= n

    def leave(space: int, sequence: int, n: int) -> None:
        if n:
            spaces[space].append((sequence, n))
            is_open[space] = True

    lengths = np.flatnonzero(left)[::-1]
    lengths = lengths[lengths > large * window]
    if len(lengths):
        n = left[lengths]
        group = (np.cumsum(n) - n) * groups // n.sum()
        members = [lengths[group == g] for g in np.unique(group)]
        for counts, repeats in optimise(np.array([m[0] for m in members]), np.array([float(left[m].sum()) for m in members]), window):
            places = [j for j in np.flatnonzero(counts) for _ in range(counts[j])]
            while repeats:  # one run per combination of actual lengths
                parts: list[int] = []
                for j in places:
                    here = [int(p) for p in members[j] if left[p] > parts.count(p)]
                    parts += here[:1]
                if not parts:
                    break
                m = min(repeats, *(int(left[p]) // c for p, c in Counter(parts).items()))
                at = 0
                for p in parts:
                    put(p, m, sequences, at)
                    at += p
                leave(window - at, sequences, m)
                sequences, repeats = sequences + m, repeats - m
    for length in range(window, 0, -1):
        while left[length]:
            fits = np.flatnonzero(is_open[length:])
            if len(fits):
                space = length + int(fits[0])
                sequence, count = spaces[space].pop()
                is_open[space] = bool(spaces[space])
            else:
                space, sequence, count = window, sequences, -(-int(left[length]) // (window // length))
                sequences += count
            m = min(int(left[length]), count)
            put(length, m, sequence, window - space)
            leave(space - length, sequence, m)
            leave(space, sequence + m, count - m)
    return Plan({p: tuple(np.array(c) for c in zip(*r)) for p, r in runs.items()}, sequences)


def _encoded(docs: DataFrame, encoder, window: int) -> DataFrame:
    """id, ids, tail (length of the last piece), tail_rank and full_rank (ranks within the task), part (the task's number, as data)."""
    end = np.array([END_ID], np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, full = np.zeros(window, np.int64), 0
        for batch in batches:
            ids, ranks = [], []
            for text in batch.column(1).to_pylist():
                ids += [encoder.encode(text or ""), end]
                length = len(ids[-2]) + 1
                ranks.append((length, length % window, seen[length % window], full))
                seen[length % window] += 1
                full += length // window
            length, tail, tail_rank, full_rank = np.array(ranks, np.int64).reshape(-1, 4).T
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.concatenate([*ids, end[:0]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, *(pa.array(c) for c in (tail, tail_rank, full_rank))], names=["id", "ids", "tail", "tail_rank", "full_rank"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(encode, f"id {kind}, ids array<int>, tail long, tail_rank long, full_rank long").withColumn("tail", F.col("tail").cast("int")).withColumn("part", F.spark_partition_id())


def pack_whole(docs: DataFrame, encoder, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, large: float = 1 / 3, groups: int = 256) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, little-endian unsigned 32-bit), sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(_encoded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), encoder, window), "whole-tokens")
    histogram = np.zeros(window + 1, np.int64)
    for r in rows.groupBy("tail").count().collect():  # window rows at most
        histogram[r["tail"]] = r["count"]
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, window, large, groups))  # bounded by lengths and groups
    earlier = stored(_earlier(rows, window), "whole-earlier")
    placed = rows.join(earlier, "part").select(
        "id", "ids", "tail", (F.col("tail_rank") + F.coalesce(F.element_at("before", F.col("tail")), F.lit(0))).alias("tail_rank"),
        (F.col("full_rank") + F.element_at("before", F.lit(0))).alias("full_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            flat = batch.column(1).values.to_numpy().astype("<u4")
            ends = batch.column(1).offsets.to_numpy()
            who, piece, length, ids, sequence, offset = ([] for _ in range(6))
            tails, tail_ranks, full_ranks = (batch.column(c).to_numpy() for c in (2, 3, 4))
            for i in range(batch.num_rows):
                own = flat[ends[i] : ends[i + 1]]
                full = len(own) // window
                pieces = [(p.sequences + int(full_ranks[i]) + k, 0) for k in range(full)]
                if tails[i]:
                    pieces.append(p.place(int(tails[i]), int(tail_ranks[i])))
                for k, (s, o) in enumerate(pieces):
                    part = own[k * window : (k + 1) * window]
                    who.append(i)
                    piece.append(k)
                    length.append(len(part))
                    ids.append(part.tobytes())
                    sequence.append(s)
                    offset.append(o)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who, pa.int32())), pa.array(piece, pa.int32()), pa.array([k * window for k in piece], pa.int64()), pa.array(length, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    out = placed.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out

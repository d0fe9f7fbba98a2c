"""Source divergence audit: how far each source's term frequencies lie from other sources' of its language.

Frequencies come from single-pass in-memory indexing. A task reads documents into one block of postings (language,
source, term: occurrences; language, term: documents); when the block has ``block_entries`` entries, it is spilled as
runs, one per hash shard, sorted by language and term and cut into chunks of at most ``CHUNK`` terms. Shards' chunks
meet sorted by their first term, and a heap merges the runs of a shard: terms below the next chunk's first term are
complete and leave. So memory is one block on the way in and the open chunks of one shard on the way out.

A group is a language and a source. With count, N and V (occurrences of a term in a group, of all kept terms in it,
number of kept terms of the language) every group gives a term p = 1 + floor(10^9 (count + 5) / (N + 5 V)). The
distance of two groups is the sum over all kept terms of |p - q|: it starts as V times the difference of their p of
an unseen term, and terms stream past and correct the pairs of their sources. Groups are taken in blocks, so
a task holds the sums of two blocks of sources at a time, and the driver the names of two blocks.

Defined results: null text, language and source count as empty; every occurring group is listed, also without terms;
rows are documents, repeated ids and rows alike; an empty table gives no rows; other input columns are not carried
along; ties of a rank go by the item's UTF-8 bytes.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

SCALE, SMOOTHING = 10**9, 5
#: Bytes of terms: letters (A-Z lower-cased) and everything beyond ASCII; all else separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CHUNK = 512
#: Hash shards per shuffle partition, so that partitions are even although a shard stays whole.
SHARDS_PER_PARTITION = 4
#: Sources of one language whose pairs are summed at a time.
SOURCE_BLOCK = 1024

#: A chunk: ``terms`` are joined by spaces, which no term has; ``sizes`` say how many postings (codes, counts) each has.
RUN = "shard int, lang binary, first binary, terms binary, documents array<long>, sizes array<int>, names array<binary>, codes array<int>, counts array<long>"


class Block:
    """Postings of one block of documents."""

    def __init__(self) -> None:
        self.documents: dict[bytes, Counter] = {}
        self.counts: dict[tuple[bytes, bytes], Counter] = {}
        self.entries = 0

    def add(self, text: bytes, lang: bytes, source: bytes) -> None:
        terms = text.translate(TERM_BYTES).split()
        documents, counts = self.documents.setdefault(lang, Counter()), self.counts.setdefault((lang, source), Counter())
        before = len(documents) + len(counts)
        counts.update(terms)
        documents.update(set(terms))
        self.entries += len(documents) + len(counts) - before + 1

    def runs(self, shards: int) -> Iterator[tuple]:
        """Chunks of the block's runs: per shard and language the terms in order, each with its postings."""
        for lang, documents in self.documents.items():
            terms = sorted(documents)
            shard = np.fromiter((crc32(t, crc32(lang)) for t in terms), np.int64, len(terms)) % shards
            order = np.argsort(shard, kind="stable")
            terms, shard = [terms[k] for k in order.tolist()], shard[order]
            place = {t: k for k, t in enumerate(terms)}
            groups = [(s, c) for (own, s), c in self.counts.items() if own == lang]
            at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for _, c in groups])
            code = np.repeat(np.arange(len(groups)), [len(c) for _, c in groups])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in groups])
            order = np.argsort(at, kind="stable")
            code, count = code[order], count[order]
            ends = np.searchsorted(at[order], np.arange(len(terms) + 1))
            sizes, per_term = np.diff(ends).astype(np.int32), np.fromiter(map(documents.__getitem__, terms), np.int64, len(terms))
            cuts = np.searchsorted(shard, np.arange(shards + 1)).tolist()
            for s in range(shards):
                for a in range(cuts[s], cuts[s + 1], CHUNK):
                    b = min(a + CHUNK, cuts[s + 1])
                    used, codes = np.unique(code[ends[a] : ends[b]], return_inverse=True)
                    yield s, lang, terms[a], b" ".join(terms[a:b]), per_term[a:b], sizes[a:b], [groups[u][0] for u in used], codes.astype(np.int32), count[ends[a] : ends[b]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["shard", "lang", "first", "terms", "documents", "sizes", "names", "codes", "counts"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _spilled_runs(docs: DataFrame, shards: int, block_entries: int) -> DataFrame:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()

        def spill() -> Iterator[pa.RecordBatch]:
            rows = []
            for chunk in block.runs(shards):
                rows.append(chunk)
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            for text, lang, source in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in range(3))):
                block.add(text, lang, source)
                if block.entries >= block_entries:
                    yield from spill()
                    block = Block()
        yield from spill()

    return docs.select("text", "lang", "source").mapInArrow(index, RUN)


def merged_terms(chunks: Iterator[tuple], least_documents: int = 1) -> Iterator[tuple[bytes, bytes, dict[bytes, int]]]:
    """lang, term, occurrences by source; chunks come ordered by shard, language and first term.

    The heap holds the next term of every open chunk of one shard and language. What is less than the newest chunk's
    first term cannot occur in a chunk still to come and is complete.
    """
    heap: list[tuple] = []
    section, opened = None, 0

    def complete(below: bytes | None) -> Iterator[tuple]:
        while heap and (below is None or heap[0][0] < below):
            term, documents, postings = heap[0][0], 0, []
            while heap and heap[0][0] == term:
                _, number, k, chunk = heap[0]
                terms, per_term, ends = chunk[:3]
                documents += per_term[k]
                postings.append((k, chunk))
                if k + 1 < len(terms):
                    heapq.heapreplace(heap, (terms[k + 1], number, k + 1, chunk))
                else:
                    heapq.heappop(heap)
            if documents >= least_documents:
                found: dict[bytes, int] = {}
                for k, (_, _, ends, names, codes, counts) in postings:
                    for code, count in zip(codes[ends[k] : ends[k + 1]].tolist(), counts[ends[k] : ends[k + 1]].tolist()):
                        found[names[code]] = found.get(names[code], 0) + count
                yield section[1], term, found

    for shard, lang, first, terms, per_term, sizes, names, codes, counts in chunks:
        if (shard, lang) != section:
            yield from complete(None)
            section = (shard, lang)
        yield from complete(first)
        opened += 1
        ends = [0, *np.cumsum(sizes).tolist()]
        heapq.heappush(heap, (first, opened, 0, (terms.split(b" "), per_term.tolist(), ends, names, codes, counts)))
    yield from complete(None)


def kept_terms(docs: DataFrame, least_documents: int = 30, block_entries: int = 500_000) -> DataFrame:
    """lang, term, sources, counts, total of every term in at least ``least_documents`` documents of its language."""
    spark = docs.sparkSession
    shards = SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(spark)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            for batch in batches:
                plain = [column.to_pylist() for column in batch.columns[:4]]
                lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(k) for k in (4, 5, 7, 8))]
                for k in range(batch.num_rows):
                    per_term, sizes, codes, counts = (values[ends[k] : ends[k + 1]] for values, ends in lists)
                    yield *(column[k] for column in plain), per_term, sizes, batch.column(6)[k].as_py(), codes, counts

        def out(rows: list[tuple]) -> pa.RecordBatch:
            langs, terms, found = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.binary()).cast(pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array([list(f) for f in found], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64())),
                 pa.array([sum(f.values()) for f in found], pa.int64())], names=["lang", "term", "sources", "counts", "total"])

        rows = []
        for row in merged_terms(chunks(), least_documents):
            rows.append(row)
            if len(rows) == 256:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    runs = _spilled_runs(docs, shards, block_entries).repartition("shard").sortWithinPartitions("shard", "lang", "first")
    return stored(runs.mapInArrow(merge, "lang string, term string, sources array<string>, counts array<long>, total long"), "frequencies")


def share(count, total, terms):
    """p of a term by the group's occurrences and the language's number of terms, exact for any size."""
    return (F.lit(1) + F.expr(f"CAST({SCALE} AS DECIMAL(20,0)) * CAST({count} + {SMOOTHING} AS DECIMAL(18,0)) div (CAST({total} AS DECIMAL(20,0)) + {SMOOTHING} * {terms})")).cast("long")


def _groups(docs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """lang, source, total, terms, number (the source's place in its language), lang_total; one row per group."""
    flat = frequencies.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    langs = frequencies.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    found = docs.select("lang", "source").distinct().join(flat, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    found = found.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    return stored(found.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")


def _passes(groups: DataFrame) -> list[list[tuple[str, int, int]]]:
    """Which (language, block, block) are summed together: at most ``SOURCE_BLOCK`` sources, or one pair of blocks."""
    out, room = [], 0
    sizes = groups.where("terms > 0").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row per language
    for lang, n in sizes:
        blocks = -(-n // SOURCE_BLOCK)
        if blocks > 1:
            out[:0] = [[(lang, a, b)] for a in range(blocks) for b in range(a, blocks)]
        elif out and n <= room:
            out[-1].append((lang, 0, 0))
            room -= n
        else:
            out.append([(lang, 0, 0)])
            room = SOURCE_BLOCK - n
    return out


def _corrections(frequencies: DataFrame, groups: DataFrame, tiles: list[tuple[str, int, int]]) -> DataFrame:
    """lang, a, b (numbers, a < b), value: corrections of the pairs of two blocks' sources, in parts."""
    spark = frequencies.sparkSession
    block = F.floor(F.col("number") / SOURCE_BLOCK)
    wanted = [(F.col("lang") == lang) & block.isin(a, b) for lang, a, b in tiles]
    rows = groups.where(_any(wanted)).collect()  # two blocks' groups at most
    sides = {}
    for lang, a, b in tiles:
        own = sorted((r["number"], r["source"], r["total"], r["terms"]) for r in rows if r["lang"] == lang)
        place = {source: k for k, (_, source, _, _) in enumerate(own)}
        below = [total + SMOOTHING * terms for _, _, total, terms in own]
        sides[lang] = (place, below, np.array([1 + SCALE * SMOOTHING // x for x in below], np.int64), np.array([n for n, _, _, _ in own], np.int64), a, b)
    shared = spark.sparkContext.broadcast(sides)

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, sources, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                place, below, unseen, _, _, _ = shared.value[lang]
                mine = [(place[s], n) for s, n in zip(sources, counts) if s in place]
                if not mine:
                    continue
                at = np.array([k for k, _ in mine])
                seen = np.array([1 + SCALE * (n + SMOOTHING) // below[k] for k, n in mine], np.int64)
                p = unseen.copy()
                p[at] = seen
                # a pair of which both sources have the term is met from both sides, any other from one
                fix = 2 * (np.abs(seen[:, None] - p[None, :]) - np.abs(unseen[at][:, None] - unseen[None, :]))
                fix[:, at] //= 2
                if lang not in sums:
                    sums[lang] = np.zeros((len(below), len(below)), np.int64)
                sums[lang][at] += fix
        for lang, twice in sums.items():
            _, _, _, numbers, a, b = shared.value[lang]
            value = np.triu(twice + twice.T, 1) // 2
            x, y = np.nonzero(value)
            here = (numbers[x] // SOURCE_BLOCK == a) & (numbers[y] // SOURCE_BLOCK == b)
            x, y = x[here], y[here]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(numbers[x]), pa.array(numbers[y]), pa.array(value[x, y])], names=["lang", "a", "b", "value"])

    langs = [lang for lang, _, _ in tiles]
    return frequencies.where(F.col("lang").isin(langs)).select("lang", "sources", "counts").mapInArrow(correct, "lang string, a long, b long, value long")


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _pairs(frequencies: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language."""
    spark = frequencies.sparkSession
    parts = spark.createDataFrame([], "lang string, a long, b long, value long")
    for tiles in _passes(groups):
        parts = parts.unionByName(_corrections(frequencies, groups, tiles))
    fixes = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("fix"))
    side = groups.withColumn("unseen", F.when(F.col("terms") > 0, share("CAST(0 AS BIGINT)", "total", "terms")).otherwise(0)).select("lang", "source", "number", "unseen", "terms")
    one, two = side.select("lang", F.col("source"), F.col("number").alias("x"), F.col("unseen").alias("p"), "terms"), side.select("lang", F.col("source").alias("item"), F.col("number").alias("y"), F.col("unseen").alias("q"))
    pairs = one.join(two, "lang").where("x <> y").withColumn("a", F.least("x", "y").cast("long")).withColumn("b", F.greatest("x", "y").cast("long"))  # the result's own rows
    value = F.col("terms") * F.abs(F.col("p") - F.col("q")) + F.coalesce("fix", F.lit(0))
    return pairs.join(fixes, ["lang", "a", "b"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = 30, top_terms: int = 50, block_entries: int = 500_000) -> DataFrame:
    """lang, source, part, item, value, rank: distances to other sources, and the terms a source has most above its language."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    frequencies = kept_terms(docs, least_documents, block_entries)
    groups = _groups(docs, frequencies)
    flat = frequencies.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), "term", F.col("e.counts").alias("own"), F.col("total").alias("all"))
    above = flat.join(groups.drop("number"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (share("own", "total", "terms") - share("all", "lang_total", "terms")).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    pairs = _pairs(frequencies, groups).withColumn("rank", F.row_number().over(order))
    both = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for rows, part in ((pairs, "pair"), (terms, "term"))]
    return both[0].unionByName(both[1])

"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct 4-word shingles (64-bit hashes of them). Each of ``REGISTERS`` registers holds
an exponentially spaced, truncated minimum: the minimum of exponential variables over the set, taken to a
logarithm of base ``BASE`` and cut to one byte. Registers of a union are the maxima of the registers, and two
registers agree the more often the more alike the sets are, so bands of registers are locality-sensitive keys.

1. Documents with equal sets form one class; only class representatives go on (a group of copies of any size
   costs one partial count per task).
2. Representatives that share a band meet in a bucket. Members of small buckets that meet twice are compared. Members of large
   ones count how many of their shingles any other such member has; who cannot reach the similarity with
   that many shared shingles leaves. Then the member that meets most others and a few more pivots are compared
   with all members; what stays is compared only where it is not yet connected and where what both lack of the
   first pivot leaves enough to share, until every bucket is one component or empty. So groups of near copies cost a few rows per member.
3. A pair's Jaccard similarity is estimated by maximum likelihood from its registers and exact set sizes; pairs
   that 0.8 is out of reach for are dropped.
4. The rest is verified on the full sets, and the verified links give components.

With 64 bands of 6 registers, a pair at 0.8 meets twice or more with probability above 1 - 1e-7.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component; a
text of fewer words than a shingle is one shingle; rows that share an id are one node; rows without an id are
kept and have no component; an empty table gives no rows; other input columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .ngrams import lower_tokens

BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
#: Register base; with one byte per register the range 1.1 ** 254 covers minima of 32-bit uniforms.
BASE, TOP = 1.1, 255
#: Buckets up to this size compare all members: at most half as many rows per member.
SMALL_BUCKET = 24
#: Pivots of a large bucket: one in the first round, then four times as many in each that follows; the pairs a member
#: that may be left for a bucket to be finished by comparing all that is not connected.
PIVOTS, MOST_PIVOTS = 6, 96
LEFT_PAIRS = 512
#: Longs of 64 bits that tell which shingles of its bucket's first pivot a member lacks, a slot per hash.
SLOTS = 16
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
_MUL = (_RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * 2 + 1)[:, None]
_WORD = _RNG.integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    tokens = lower_tokens(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    w = np.fromiter((crc32(t) | crc32(t, 0x5BD1E995) << 32 for t in tokens), np.uint64, len(tokens))
    w = _mix(w + np.fromiter(map(len, tokens), np.uint64, len(tokens)))
    size = min(width, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (w[k : len(w) - size + 1 + k] ^ _WORD[k]) * _WORD[k]
    return np.unique(_mix(h))


def registers(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS bytes; the minimum over the set comes first, as the logarithm is monotone."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 4096):
        block = h[None, at : at + 4096]
        np.minimum(low, ((block ^ _XOR) * _MUL).min(axis=1), out=low)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + 20, 0, TOP).astype(np.uint8)


def likely_at_least(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float, slack: float = 16.0) -> np.ndarray:
    """Can the pairs' similarity be ``least`` or more? True unless the joint likelihood there stays e^-slack below its maximum.

    ``a`` and ``b`` are register matrices, a pair per row. The likelihood of the counts of smaller, greater and
    equal registers follows from the sets' sizes and their similarity.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1.0)

    def loglik(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1.0))

    most = np.minimum(u / v, v / u)  # no similarity exceeds the ratio of the sizes
    best = np.max([loglik(most * x) for x in np.linspace(0, 1, 33)], axis=0)
    at = np.max([loglik(np.minimum(least, most) + x * np.maximum(most - least, 0)) for x in np.linspace(0, 1, 17)], axis=0)
    return (n_a * 100 >= n_b * 100 * least - 1e-6) & (n_b * 100 >= n_a * 100 * least - 1e-6) & (at >= best - slack)


def _print(shingles: np.ndarray) -> bytes | None:
    """Sixteen bytes that name a set: two sums over differently mixed hashes."""
    return np.array([_mix(shingles ^ _WORD[6]).sum(), _mix(shingles ^ _WORD[7]).sum()]).tobytes() if len(shingles) else None


def _sketch_rows(docs: DataFrame, width: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, regs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                prints.append(_print(s))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())],
                names=["id", "n_shingles", "print", "registers"])

    return docs.mapInArrow(sketch, "id long, n_shingles long, print binary, registers binary").withColumn("row", F.monotonically_increasing_id())


def _band_rows(reps: DataFrame) -> DataFrame:
    """(rep, size, bucket) rows; the bucket's key is a hash of the band's number and its registers."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("registers", i * ROWS + 1, F.lit(ROWS)))
    return reps.select("rep", F.col("n_shingles").cast("int").alias("size"), F.posexplode(parts).alias("band", "part")).select("rep", "size", F.xxhash64("band", "part").alias("bucket"))


def _near_sizes(a: str, b: str, percent: int):
    """Sets whose sizes differ more than this cannot be alike enough."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _sets(wanted: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """rep, shingles (the full set, sorted) of the wanted representatives, read from their texts."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            ok = [_print(s) == p for s, p in zip(found, batch.column("print").to_pylist())]  # an id may have several texts
            out = pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "shingles"])
            yield out.filter(pa.array(ok, pa.bool_()))

    named = wanted.join(reps.select("rep", "id", "print"), "rep")
    full = docs.join(named, "id").select("rep", "print", "text").mapInArrow(sets, "rep long, shingles binary")
    return stored(full.dropDuplicates(["rep"]), "near-sets")


def _most_shared(sets: DataFrame) -> DataFrame:
    """rep, most: how many shingles of a set any other of the sets has; a bound on what it shares with one of them."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, own in zip(batch.column("rep").to_pylist(), batch.column("shingles").to_pylist()):
                own = np.frombuffer(own, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rep)), pa.array(own)], names=["rep", "shingle"])

    shared = sets.select("rep", "shingles").mapInArrow(rows, "rep long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    alone = shared.where("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    return sets.select("rep", (F.length("shingles") / 8).cast("int").alias("size")).join(alone, "rep", "left").select("rep", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("most"))


def _verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives whose full sets are at least ``percent`` alike; ``known`` holds sets read before."""
    least = percent / 100
    side = reps.select("rep", "n_shingles", "registers")
    both = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                ok = likely_at_least(ra, rb, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")), least)
                yield batch.filter(pa.array(ok)).select(["a", "b"])

    candidates = stored(both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(likely, "a long, b long"), "near-candidates")
    needed = candidates.select(F.col("a").alias("rep")).unionByName(candidates.select(F.col("b").alias("rep"))).distinct()
    full = known.unionByName(_sets(needed.join(known.select("rep"), "rep", "left_anti"), reps, docs, width))

    return _alike(_shared_shingles(candidates, full), percent)


def _roots(hooks: DataFrame) -> DataFrame:
    """(a, up) with up the end of every chain of hooks; a root hooks to itself. Chains get half as long in every turn."""
    while True:
        further = hooks.select(F.col("a").alias("up"), F.col("up").alias("top"))
        hooks = stored(hooks.select("a", "up").join(further, "up").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "hooks")
        if hooks.where("moved").isEmpty():
            return hooks.select("a", "up")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label) with label the least rep reachable: hook to the least neighbour, follow hooks to their roots, link the roots.

    Every turn replaces links by distinct ones between roots, at most half as many nodes, so the links are read once, not once a turn.
    """
    edges = stored(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = nodes.select("rep", F.col("rep").alias("label"))
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _roots(stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "hooks"))
        labels = stored(labels.join(roots.toDF("label", "up"), "label", "left").select("rep", F.coalesce("up", "label").alias("label")), "labels")
        ends = edges.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b").where("x != y")
        edges = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels


def _connected(reps: DataFrame, links: DataFrame) -> DataFrame:
    return stored(components(reps, links), "connected")


def _small_pairs(meet: DataFrame, percent: int) -> DataFrame:
    small = meet.where(F.col("n") <= SMALL_BUCKET)
    left, right = (small.select("bucket", F.col("rep").alias(x), F.col("size").alias(f"n_{x}")) for x in "ab")
    return left.join(right, "bucket").where((F.col("a") < F.col("b")) & _near_sizes("n_a", "n_b", percent)).select("a", "b")


def _met_twice(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs that share two small buckets, or one while they may share large ones as well."""
    met = stored(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "met")
    ids = members.select(F.col("rep").alias("member"))
    once = met.where("n = 1").join(ids, F.col("a") == F.col("member"), "left_semi").join(ids, F.col("b") == F.col("member"), "left_semi")
    return met.where("n > 1").unionByName(once).select("a", "b")


def _pivots(active: DataFrame, turn: int) -> DataFrame:
    """(bucket, pivot, pivot_size): first the member that meets most others, later more and more drawn by hash."""
    member = F.struct(F.col("rep").alias("pivot"), F.col("size").alias("pivot_size"))
    if turn == 0:
        drawn = [F.max(F.struct("weight", F.xxhash64("rep").alias("h"), member.alias("m")))]
    else:
        drawn = [F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(turn * MOST_PIVOTS + k)).alias("h"), member.alias("m"))) for k in range(min(MOST_PIVOTS, PIVOTS * 4**turn))]
    rows = active.groupBy("bucket").agg(*[d.alias(f"p{k}") for k, d in enumerate(drawn)])
    return rows.select("bucket", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.m") for k in range(len(drawn))]))).alias("p")).select("bucket", "p.*")


def _slots(shingles: np.ndarray) -> np.ndarray:
    """SLOTS longs with the bits of the hashes' slots set; equal hashes have equal slots."""
    bits = np.zeros(64 * SLOTS, np.uint8)
    bits[shingles % np.uint64(64 * SLOTS)] = 1
    return np.packbits(bits).view(np.int64)


def _spokes(members: DataFrame, known: DataFrame) -> DataFrame:
    """Shared shingles of members (a) and pivots (b), and in ``lost`` the slots of the pivot's shingles that a member lacks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist())]
            lacks = [np.setdiff1d(y, x, assume_unique=True) for x, y in both]
            n = [len(y) - len(l) for (_, y), l in zip(both, lacks)], [len(x) for x, _ in both], [len(y) for _, y in both]
            lost = pa.array([_slots(l) for l in lacks], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int32()) for c in n), lost], names=["a", "b", "shared", "n_a", "n_b", "lost"])

    sets = known.select("rep", "shingles")
    rows = members.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b").select("a", "b", "s_a", "s_b")
    return stored(rows.mapInArrow(count, "a long, b long, shared int, n_a int, n_b int, lost array<bigint>"), "spokes")


def _shared_shingles(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, shared, n_a, n_b: the exact number of shingles that both sets have, and their sizes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist())]
            n = ([len(np.intersect1d(x, y, assume_unique=True)) for x, y in both], [len(x) for x, _ in both], [len(y) for _, y in both])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int32()) for c in n)], names=["a", "b", "shared", "n_a", "n_b"])

    sets = known.select("rep", "shingles")
    rows = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b").select("a", "b", "s_a", "s_b")
    return stored(rows.mapInArrow(count, "a long, b long, shared int, n_a int, n_b int"), "shared")


def _alike(counted: DataFrame, percent: int) -> DataFrame:
    return counted.where((100 + percent) * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _cross_pairs(active: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members with different labels: those outside a bucket's main label against all others.

    A pair is made in the first bucket that it shares, and only if it can be alike enough: two sets share no more
    than the part that either shares with the bucket's pivot, less a shingle for every slot of which only the other
    lacks some, plus the smaller rest that either shares with any member.
    """
    rows = active.join(buckets.select("bucket", "main"), "bucket")
    places = rows.groupBy("rep").agg(F.collect_set("bucket").alias("places"))  # BANDS at most
    rows = rows.join(places, "rep")
    rest = rows.where("label != main").select("bucket", F.col("rep").alias("a"), F.col("label").alias("x"), F.col("size").alias("n"), F.col("inside").alias("i"), F.col("outside").alias("o"), F.col("places").alias("p"), F.col("lost").alias("s"))
    other = rows.select("bucket", F.col("rep").alias("b"), F.col("label").alias("y"), F.col("size").alias("m"), F.col("inside").alias("j"), F.col("outside").alias("u"), F.col("places").alias("q"), F.col("lost").alias("t"), "main")
    once = (F.col("y") == F.col("main")) | (F.col("a") < F.col("b"))
    enough = (100 + percent) * (F.least("i", "j") + F.least("o", "u")) >= percent * (F.col("n") + F.col("m"))

    def only(x: str, y: str):  # slots set in y, not in x
        return sum(F.bit_count(F.col(y)[k].bitwiseAND(F.bitwise_not(F.col(x)[k]))) for k in range(SLOTS))

    both = F.least(F.col("i") - only("s", "t"), F.col("j") - only("t", "s"))
    enough &= (100 + percent) * (both + F.least("o", "u")) >= percent * (F.col("n") + F.col("m"))
    first = F.col("bucket") == F.array_min(F.array_intersect("p", "q"))
    pairs = rest.join(other, "bucket").where((F.col("x") != F.col("y")) & once & _near_sizes("n", "m", percent) & enough & first)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _links(reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links that connect whatever comparing all members of every bucket would connect."""
    bands = stored(_band_rows(reps), "bands")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    meet = stored(bands.join(sizes, "bucket"), "buckets")
    large = meet.where(F.col("n") > SMALL_BUCKET)
    members = large.groupBy("rep").agg(F.sum("n").alias("weight"))
    known = _sets(members.select("rep"), reps, docs, width)  # of all members of large buckets
    links = _verify(_met_twice(_small_pairs(meet, percent), members), reps, docs, known, width, percent)
    members = stored(members.join(_most_shared(known), "rep"), "members")
    # who shares too little with all members together cannot be alike enough to any
    active = stored(large.join(members, "rep").where(100 * F.col("most") >= percent * F.col("size")).select("bucket", "rep", "size", "most", "weight"), "active")
    if active.isEmpty():
        return links
    hub = active.join(stored(_pivots(active, 0), "pivots"), "bucket")
    spokes = _spokes(hub.where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), known)
    links = links.unionByName(_alike(spokes, percent))
    hub = hub.join(spokes.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "shared", "lost"), ["rep", "pivot"])  # without the pivots themselves
    active = stored(hub.select("bucket", "rep", "size", "weight", F.col("shared").alias("inside"), (F.col("most") - F.col("shared")).alias("outside"), "lost"), "active")
    turn = 1
    while not active.isEmpty():
        labels = _connected(reps, links)
        links = labels.where("rep != label").select(F.col("label").alias("a"), F.col("rep").alias("b"))  # connect the same with a link per member
        active = stored(active.join(labels, "rep"), "active")
        state = active.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(
            F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"))
        state = stored(state.where("labels > 1").withColumn("near", (F.col("n") * F.col("n") - F.col("squares")) / 2 <= LEFT_PAIRS * F.col("n")), "bucket-state")
        pairs = _cross_pairs(active, state.where("near"), percent)
        active = stored(active.join(state.where("not near").select("bucket"), "bucket", "left_semi").drop("label"), "active")
        if not active.isEmpty():
            pivots = stored(_pivots(active, turn), "pivots")
            hub = active.join(pivots, "bucket").where((F.col("rep") != F.col("pivot")) & _near_sizes("size", "pivot_size", percent))
            pairs = pairs.unionByName(hub.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")))
            active = stored(active.join(pivots.select("bucket", F.col("pivot").alias("rep")), ["bucket", "rep"], "left_anti"), "active")
        links = links.unionByName(_alike(_shared_shingles(pairs.distinct(), known), percent))
        turn += 1
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept (its id is the least of its component) for every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(_sketch_rows(docs, width), "sketches")
    some = rows.where("print is not null and id is not null")
    classes = stored(some.groupBy("print", "n_shingles").agg(F.min(F.struct("id", "row")).alias("first")).select("print", "n_shingles", F.col("first.row").alias("rep"), F.col("first.id").alias("id")), "classes")
    reps = stored(classes.join(rows.select(F.col("row").alias("rep"), "registers"), "rep"), "representatives")
    links = _links(reps, docs, width, percent)
    members = some.select("id", "print").distinct().join(classes.select("print", "rep"), "print")  # an id with several texts joins their classes
    shared = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count("*").alias("n")).where("n > 1")
    own = members.join(shared.select("id", "a"), "id").select("a", F.col("rep").alias("b")).where("a != b")
    labels = _connected(reps, links.unionByName(own))
    named = classes.join(labels, "rep")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    prints = named.join(least, "label").select("print", "component_id")
    out = rows.select("id", "n_shingles", "print").join(prints, "print", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

"""SetSketch near-duplicates against all-pairs brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm import setsketch
from textguard.llm.ngrams import lower_tokens
from textguard.llm.setsketch import components, likely_at_least, near_duplicates, registers, shingle_set

from .helpers import MESSY, key, messy, prose


def brute(rows, width=4, percent=80):
    sets = []
    for _, t in rows:
        w = lower_tokens(t)
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            alike = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if (same and sets[i] and sets[j]) or alike:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    twins = {}
    for i, (d, _) in enumerate(rows):  # a row without an id takes the component of its set
        if d is not None and sets[i]:
            twins[frozenset(sets[i])] = least[find(i)]
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)] if d is not None else twins.get(frozenset(sets[i])) if sets[i] else None
        out.append((d, len(sets[i]), c, True if d is None else c == d))
    return out


def edited(words, rng, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = "edit%d" % rng.integers(1 << 30)
    return " ".join(words)


def corpus():
    rng = np.random.default_rng(4)
    rows = list(MESSY)
    for g in range(12):
        base = prose(1000 + g, 150 + 20 * g).split()
        for k in range(6):
            rows.append((len(rows) + 100, edited(base, rng, k * 2)))
    for n in range(1, 9):
        rows += [(len(rows) + 100, prose(77, n)), (len(rows) + 101, prose(77, n).upper())]
    long = prose(88, 9000).split()
    rows += [(len(rows) + 100, edited(long, rng, n)) for n in (0, 100, 200, 350)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    got = [tuple(r) for r in near_duplicates(messy(spark, rows)).collect()]
    assert key(got) == key(brute(rows))
    five = [tuple(r) for r in near_duplicates(messy(spark, rows), width=5).collect()]
    assert key(five) == key(brute(rows, width=5))
    assert near_duplicates(messy(spark).limit(0)).count() == 0


def test_large_groups_take_pivots(spark, monkeypatch):
    """Buckets far beyond the small size: variants of a text that are mostly not alike enough to one another."""
    monkeypatch.setattr(setsketch, "SMALL_BUCKET", 3)
    monkeypatch.setattr(setsketch, "PIVOTS", 2)
    rng = np.random.default_rng(9)
    base = prose(5, 160).split()
    rows = [(i, edited(base, rng, int(rng.integers(2, 9)))) for i in range(70)] + [(500 + i, " ".join(base)) for i in range(30)]
    got = [tuple(r) for r in near_duplicates(messy(spark, rows)).collect()]
    assert key(got) == key(brute(rows))


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert key(tuple(r) for r in near_duplicates(docs).collect()) == key(brute(rows))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(100, 160)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in sorted({x for l in links for x in l} | {999})], "rep long")
    got = dict(map(tuple, components(nodes, spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 1 if i <= 60 else 100 if 100 <= i <= 200 else 300 if i < 400 else 999 for i in got}
    assert components(nodes, spark.createDataFrame([], "a long, b long")).where("rep != label").count() == 0


def test_components_take_every_link_once_and_then_links_of_roots(spark, monkeypatch):
    links = [(i, j) for i in range(40) for j in range(i)] + [(100, 39)]  # a group of copies, and one more beside its greatest id
    kept, rows = setsketch.stored, []

    def counted(df, name):
        out = kept(df, name)
        if name == "edges":
            rows.append(out.count())
        return out

    monkeypatch.setattr(setsketch, "stored", counted)
    nodes = spark.createDataFrame([(i,) for i in [*range(40), 100]], "rep long")
    got = components(nodes, spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["label"] for r in got} == {0} and len(got) == 41
    assert sum(rows) <= len(links) + 41


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.8, 0.95])
def test_registers_agree_with_similarity_and_likelihood_keeps_alike_pairs(similarity):
    rng = np.random.default_rng(int(similarity * 100))
    n = 600
    shared = int(2 * n * similarity / (1 + similarity))
    kept, equal = [], []
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared : 2 * n - shared])
        ra, rb = registers(a), registers(b)
        union = registers(np.unique(np.concatenate([a, b])))
        assert (union == np.maximum(ra, rb)).all()  # registers merge
        equal.append((ra == rb).mean())
        kept.append(likely_at_least(ra[None], rb[None], np.array([float(n)]), np.array([float(n)]), 0.8)[0])
    assert abs(np.mean(equal) - similarity) < 0.06
    assert all(kept) if similarity >= 0.8 else not any(kept) if similarity <= 0.3 else True


def test_shingle_sets_of_short_texts():
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("a b")) == len(shingle_set("a")) == len(shingle_set("a b c d")) == 1
    assert (shingle_set("a b") == shingle_set("A  B")).all() and (shingle_set("a b") != shingle_set("b a")).all()
    assert len(shingle_set("a b a b a b a b")) == 2

"""Source divergence: block postings, run merging and pair corrections against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from textguard.llm import divergence as D
from textguard.llm.divergence import Block, merged_terms, source_divergence

from .helpers import CLASHES, LONG_TEXT

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = Counter(t.translate(LOWER) for t in TERM.findall(text or ""))
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = set()
    for lang in documents:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        groups = {s: c for (own, s), c in counts.items() if own == lang}
        total = Counter()
        for c in groups.values():
            total.update(c)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        ps = {s: {t: p(c, t) for t in kept} for s, c in groups.items()}
        q = {t: p(total, t) for t in kept}
        for s in groups:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, ps[s][t] - q[t]) for t in kept if groups[s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[: top if part == "term" else None], 1)}
    return out


def corpus(seed, documents=120, sources=7):
    rng = random.Random(seed)
    words = ["the", "The", "Été", "été", "中文", "ｗｉｄｅ", "naïve", "a1b", "x-y", " ", "don't", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(documents):
        source = rng.choice([f"s{rng.randrange(sources)}", "s0", "s0", None, "", "ß", "Z"])
        rows.append((k, " ".join(rng.choice(words[: 5 + len(source or "") * 9]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None, "fr"]), source))
    return rows + [(500, None, "en", "nothing"), (501, "", "xx", "alone"), (502, "123 !", "xx", "other"), (503, LONG_TEXT, "en", "long"), (503, LONG_TEXT, "en", "long"), (None, "the the", "", "")]


def frame(spark, rows):
    extra = [c for c in CLASHES if c not in ("lang", "source", "text")] + ["term", "total", "terms", "counts", "number", "rank", "value"]
    return spark.createDataFrame([(*r, *range(len(extra))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in extra)).repartition(5)


@pytest.mark.parametrize("least, top, entries, sources", [(5, 50, 300_000, 1024), (2, 3, 40, 5), (1, 50, 1, 7), (1000, 50, 500, 6)])
def test_against_plain_counting(spark, monkeypatch, least, top, entries, sources):
    """One block, many runs, a run per document; sources in one block, in pairs of blocks; no term kept."""
    monkeypatch.setattr(D, "SOURCE_BLOCK", sources)
    monkeypatch.setattr(D, "CHUNK", 3)
    rows = corpus(least)
    found = source_divergence(frame(spark, rows), least_documents=least, top_terms=top, block_entries=entries).collect()
    want = plain(rows, least, top)
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_counts_beyond_long_arithmetic(spark):
    row = spark.createDataFrame([(3 * 10**12, 5 * 10**13, 2 * 10**6)], "n long, total long, v long").select(D.share("n", "total", "v").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (3 * 10**12 + 5) // (5 * 10**13 + 5 * 2 * 10**6)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_heap_merges_overlapping_runs():
    chunks, want = [], defaultdict(lambda: [0, Counter()])
    for seed in range(9):
        block, rng = Block(), random.Random(seed)
        for _ in range(20):
            text = " ".join(chr(97 + rng.randrange(26)) * rng.randint(1, 3) for _ in range(30))
            lang, source = rng.choice([b"en", b"e"]), rng.choice([b"x", b"y"])
            block.add(text.encode(), lang, source)
            for t, n in Counter(text.split()).items():
                entry = want[lang, t.encode()]
                entry[0] += 1
                entry[1][source] += n
        chunks += block.runs(4)
    chunks.sort(key=lambda c: c[:3])
    found = list(merged_terms(iter(chunks)))
    assert {(lang, t): Counter(f) for lang, t, f in found} == {k: c for k, (_, c) in want.items()} and len(found) == len(want)
    frequent = {(lang, t) for lang, t, _ in merged_terms(iter(chunks), 28)}
    assert frequent == {k for k, (n, _) in want.items() if n >= 28} and 0 < len(frequent) < len(want)

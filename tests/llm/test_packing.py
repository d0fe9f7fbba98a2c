"""Packing: exact round trip of every id, gapless sequences, little padding."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textguard.llm.packing import END_ID, fillings, make_plan, pack, solve_counts
from textguard.llm.queries import QUERIES, public_encoder

from .helpers import MESSY, messy, prose

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, END_ID]


def check(rows, pieces, window):
    """Every row's ids come back exactly once; returns padded tokens."""
    found = Counter()
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id, p.doc_tokens].append(p)
    for (doc, total), ps in by.items():
        ps = sorted(ps, key=lambda p: (p.start, p.length))
        copies = sum(p.start == 0 for p in ps)
        for p in ps:
            assert len(p.ids) == 4 * p.length and 0 < p.length <= window
        assert sum(p.length for p in ps) == copies * total
        found[doc] += copies
    assert found == Counter(d for d, _ in rows)
    want = defaultdict(Counter)
    for d, t in rows:
        for k, i in enumerate(ids_of(t)):
            want[d][k, i] += 1
    got = defaultdict(Counter)
    for p in pieces:
        for k, i in enumerate(np.frombuffer(p.ids, "<u4").tolist()):
            got[p.doc_id][p.start + k, i] += 1
    assert got == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(len(ids_of(t)) for _, t in rows)


def test_messy_rows_round_trip(spark):
    pieces = pack(messy(spark), public_encoder()).collect()
    check(MESSY, pieces, 1024)
    assert pack(messy(spark).limit(0), public_encoder()).count() == 0


def test_literals_of_added_tokens_are_their_ids(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f" {end}\n{end} ", f"x{end}'s", "<|endoftext|", "<|endoftext |>", "<|ENDOFTEXT|>", f"<{end}>", f"\u00e9{end}\u00f1 1{end}2", f"<|endoftext{end}"]
    assert public_encoder().encode(texts[0]) == [64, 220, 50256, 275]
    assert [[*public_encoder().encode(t), END_ID] for t in texts] == [ids_of(t) for t in texts]
    rows = list(enumerate(texts + [prose(3, 2000) + end + prose(4, 2000)]))
    check(rows, pack(messy(spark, rows), public_encoder()).collect(), 1024)


def test_small_window_many_rows(spark):
    rows = [(i % 400, prose(i, 1 + (i * 37) % 90)) for i in range(500)] + MESSY[:5]
    padding, total = check(rows, pack(messy(spark, rows), public_encoder(), window=64, slack=1).collect(), 64)
    assert padding <= 0.02 * total + 64


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    padding, total = check(rows, pack(spark.read.parquet(f"{SF}/documents.parquet"), public_encoder()).collect(), 1024)
    assert padding <= 0.01 * total + 1024
    out = QUERIES["op1_packing"](spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_least_squares_finds_an_exact_solution():
    combos = fillings(np.array([10, 20, 30, 34, 44, 54]), 64)
    assert {tuple(c) for c in combos} == {(54, 10, 0), (44, 20, 0), (44, 10, 10), (34, 30, 0), (34, 20, 10)}
    h = np.zeros(65)
    h[[54, 10, 44, 20, 34, 30]] = [100, 100, 40, 40, 70, 70]
    x = solve_counts(combos, h)
    made = np.zeros(65)
    for c, n in zip(combos, x):
        for length in c[c > 0]:
            made[length] += n
    assert (x >= 0).all() and np.abs(made - h).max() < 1


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(0)
    for window, most in ((64, 50), (1024, 30), (16, 500), (1024, 3)):
        h = rng.integers(0, most, window + 1)
        h[0] = h[window] = 0
        plan = make_plan(h, window)
        fill = defaultdict(list)
        for length in range(1, window):
            for rank in range(h[length]):
                ps = plan.places(length, rank)
                assert sum(n for _, _, n in ps) == length
                for s, o, n in ps:
                    fill[s].append((o, n))
        assert len(fill) == plan.sequences and max(fill, default=-1) == plan.sequences - 1
        short = 0
        for ps in fill.values():
            at = 0
            for o, n in sorted(ps):
                assert o == at
                at += n
            short += at < window - 8
        assert short <= 1
    assert make_plan(np.zeros(65, int), 64).sequences == 0

"""Whole-document packing: ids of the json tokenizer, exact round trip, gapless and few sequences."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textguard.llm import grouped_packing as G
from textguard.llm.grouped_packing import WordEncoder, best_configuration, make_plan, optimise, pack_whole
from textguard.llm.queries import QUERIES

from .helpers import MESSY, messy, prose

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), WordEncoder(PATH)
SIGNS = "abcXYZ019'.,!?<|>\x00\x0b\x0c\r\n\t \x1c\x7f\x85 ÀÖ×÷ÿßµªéñéΣσİıǆÆ中文한🙂​﻿٣²½ﬁ _-"


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=SIGNS, max_size=60), st.text(max_size=40)))
def test_ids_equal_the_json_file(text):
    assert ENCODER.encode(text).tolist() == ids_of(text)[:-1]


def test_ids_of_literals_long_words_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(G, "CACHED_WORDS", 50)
    for text in ("a <|endoftext|>b", "<|startoftext|><|endoftext|>", "don't I'LL 've" * 9, "x" * 5000, "ß" * 3000 + " ÿ", "!" * 999, "日本" * 500, prose(3, 400), prose(4, 400)):
        assert ENCODER.encode(text).tolist() == ids_of(text)[:-1]
    for k in range(32, 0x250):
        assert ENCODER.encode(f"a{chr(k)}b {chr(k)}").tolist() == ids_of(f"a{chr(k)}b {chr(k)}")[:-1], k


def check(rows, pieces, window, with_ids=True):
    """Every row comes back whole, sequences are gapless and not too long; returns the number of sequences."""
    want, got = Counter(), Counter()
    for doc, text in rows:
        ids = ids_of(text)
        want.update((doc, k // window, k, tuple(ids[k : k + window])) for k in range(0, len(ids), window))
    sequences = defaultdict(list)
    for p in pieces:
        ids = tuple(np.frombuffer(p["ids"], "<u4").tolist())
        assert len(ids) == p["length"]
        got[p["doc_id"], p["piece"], p["start"], ids] += 1
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


@pytest.mark.parametrize("window", [16, 256, 2048])
def test_messy_rows_round_trip(spark, window):
    check(MESSY, pack_whole(messy(spark), ENCODER, window=window).collect(), window)


def test_empty_table(spark):
    assert pack_whole(spark.createDataFrame([], "doc_id long, text string"), ENCODER).collect() == []


def test_query_packs_near_the_bound(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sequences = check(rows, pack_whole(docs, ENCODER).collect(), 2048)
    assert sequences <= 1.02 * sum(len(ids_of(t)) for _, t in rows) / 2048 + 1
    found = QUERIES["op13_best_fit"](spark, SF)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.select("sequence_id").distinct().count() == sequences


def placed(histogram, window, **options):
    """Sequences of a plan, after checking that every rank of every length has one place."""
    plan = make_plan(histogram, window, **options)
    fill = defaultdict(list)
    for length in np.flatnonzero(histogram):
        for rank in range(histogram[length] if length else 0):
            sequence, offset = plan.place(int(length), rank)
            fill[sequence].append((offset, int(length)))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert set(fill) == set(range(plan.sequences))
    return plan.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_near_the_least(seed):
    rng = np.random.default_rng(seed)
    window = 2048
    lengths = [rng.integers(1, window, 3000), np.minimum(rng.lognormal(5.5, 1, 5000), window - 1).astype(int), rng.integers(700, 1000, 900),
               np.full(50, 1500), rng.choice([512, 640, 768, 1024, 256, 30], 4000), rng.integers(600, 800, 7)][seed]
    histogram = np.bincount(lengths, minlength=window + 1)
    # no packing needs fewer: total length, pieces above half a window, pieces above a third in pairs
    least = max(-(-lengths.sum() // window), (lengths > window / 2).sum(), -(-(lengths > window / 3).sum() // 2))
    assert placed(histogram, window) <= 1.012 * least + 1


def test_configurations_are_optimal_on_small_cases():
    sizes = np.array([7, 5, 3])
    worth, counts = best_configuration(sizes, np.array([0.6, 0.5, 0.25]), 15)
    assert worth == pytest.approx(1.5) and counts.tolist() == [0, 3, 0]
    found = optimise(np.array([6, 4]), np.array([10.0, 10.0]), 10)
    assert sum(n for _, n in found) == 10 and (sum(c * n for c, n in found) == [10, 10]).all()
    assert sum(n for _, n in optimise(np.array([9]), np.array([random.Random(1).randint(1, 99)]), 10)) > 0

"""Toxicity, language model, importance resampling and quality rules."""

import math
import os
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textguard.llm import quality_rules, queries
from textguard.llm.ngrams import lower_tokens, ngram_buckets
from textguard.llm.quality_rules import base_counts, best_cut, best_threshold, fit_quality
from textguard.llm.recurrent_lm import Network, START, WORDS, _fit, score_documents
from textguard.llm.resample import gumbel, kth_largest, resample
from textguard.llm.toxicity import fit_toxicity

from .helpers import LONG_TEXT, MESSY, messy, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def toxic_corpus():
    bad = ("grobnak", "vilmush", "snarfle")
    rows = []
    for i in range(240):
        words = prose(500 + i, 80).split()
        toxic = i % 4 == 0
        if toxic:
            for k in range(4):
                words.insert(7 + 17 * k, bad[(i // 4 + k) % 3])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_held_out_rows_and_survives_messy_ones(spark):
    rows = toxic_corpus()
    docs = messy(spark, [r[:2] for r in rows])
    labels = labelled(spark, [(i, 1, t) for i, _, t in rows if i % 3] + [(i, None, None) for i in (900, 901)])
    model = fit_toxicity(docs, labels)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", model.column(F.col("text")).alias("s")).collect()}
    held = [(i, t) for i, _, t in rows if i % 3 == 0]
    assert sum((scores[i] >= 0.5) == bool(t) for i, t in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in scores.values())
    odd = messy(spark).select("doc_id", "text", model.column(F.col("text")).alias("s")).collect()
    assert len(odd) == len(MESSY) and all(0 <= r.s < 0.5 for r in odd)
    assert model.score(LONG_TEXT + " grobnak vilmush snarfle grobnak vilmush snarfle") > model.score(LONG_TEXT)  # the end of a long text counts
    none = fit_toxicity(docs, labels.limit(0))
    assert none.score(rows[0][1]) < 0.5 and fit_toxicity(docs.limit(0), labels).score("x") < 0.5
    assert fit_toxicity(docs, labels.where("toxic = 1")).score(rows[0][1]) < 0.5


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_counts_equal_brute_force(spark):
    twice = prose(3, 20)
    texts = [t for _, t in MESSY] + [twice + "\n" + twice, twice + " a " + " ".join(twice.split()[5:14]), "a " * 40, "a\n\na\n a\nb\r\na", "###|<>&%$*", "a b c d e f g h " * 2, prose(5, 8)]
    assert [base_counts(t) for t in texts] == [brute_base(t) for t in texts]
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert [base_counts(t) for t in real] == [brute_base(t) for t in real]


def test_quality_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    raw, good = np.zeros(1 << 16), np.zeros(1 << 16)
    for i, t in docs.items():
        for b in ngram_buckets(lower_tokens(t)):
            raw[b] += 1
            good[b] += labels.get(i) == 1
    ratios = np.log((good + 1) / (good.sum() + 65536)) - np.log((raw + 1) / (raw.sum() + 65536))
    ratio = {i: ratios[ngram_buckets(lower_tokens(t))].mean() for i, t in docs.items()}
    failed = {i: (c := brute_base(t))[0] < 20 or 100 * c[4] > 30 * c[0] for i, t in docs.items()}
    cut = best_threshold(*(np.array([ratio[i] for i, q in labels.items() if q == k and i in docs and not failed[i]]) for k in (1, 0)), 0.001)
    got = queries.QUERIES["op9_quality_rules"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(docs[r.doc_id])
        assert r.base_failed == failed[r.doc_id] and abs(r.ratio - ratio[r.doc_id]) < 1e-5
        assert abs(r.ratio - cut) < 1e-5 or r.kept == (not failed[r.doc_id] and ratio[r.doc_id] >= cut)


def test_quality_on_messy_and_empty_tables(spark):
    labels = labelled(spark, [(5, 1, 0), (7, 1, 0), (8, 0, 0), (None, 1, 0), (11, None, None)])
    model = fit_quality(messy(spark), labels)
    out = messy(spark).select("doc_id", "text", model.columns(F.col("text")).alias("s")).select("*", model.base_failed(F.col("s")).alias("f"), model.kept(F.col("s")).alias("k")).collect()
    assert len(out) == len(MESSY) and all(r.f and not r.k for r in out if not r.text or len(r.text.split()) < 20)
    assert fit_quality(messy(spark).limit(0), labels).threshold == float("-inf")
    assert fit_quality(messy(spark), labels.limit(0)).threshold == float("-inf")


def test_models_learn_from_every_labelled_row(spark):
    """More labelled rows than any sample of 8,000 takes, whether their ids are sent to all tasks or dealt."""
    texts = {i: f"w{i % 97} v{i // 97} " + " ".join(f"u{(i + k) % 31}" for k in range(20)) for i in range(9000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    quality = {i: int(i % 20 != 0) for i in texts}
    labels = labelled(spark, [(i, q, 0) for i, q in quality.items()] + [(40, 1, 0)])  # both good and bad: bad
    raw, good = np.zeros(1 << 16), np.zeros(1 << 16)
    for i, t in texts.items():
        own = ngram_buckets(lower_tokens(t))
        np.add.at(raw, own, 1)
        np.add.at(good, own, quality[i])
    ratios = np.log((good + 1) / (good.sum() + 65536)) - np.log((raw + 1) / (raw.sum() + 65536))
    ratio = np.array([np.float64(np.float32(ratios)[ngram_buckets(lower_tokens(t))].mean()) for t in texts.values()])
    q = np.array(list(quality.values()))
    for broadcast_ids in (0, 100_000):
        model = fit_quality(docs, labels, max_loss=0.05, broadcast_ids=broadcast_ids)
        assert np.abs(model.ratios - ratios).max() < 1e-5
        assert abs(model.threshold - best_threshold(ratio[q == 1], ratio[q == 0], 0.05)) < 1e-5
    both = good.copy()
    np.add.at(both, ngram_buckets(lower_tokens(texts[40])), 1)  # here a row that any label calls good counts
    ratios = np.log((both + 1) / (both.sum() + 65536)) - np.log((raw + 1) / (raw.sum() + 65536))
    for r in resample(docs, labels, broadcast_ids=0).collect():
        assert abs(r.log_weight - ratios[ngram_buckets(lower_tokens(texts[r.doc_id]))].sum()) < 1e-3


def test_labelled_rows_are_measured_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def columns(self, text):
        @F.pandas_udf(quality_rules.BASE)
        def measure(texts: pd.Series) -> pd.DataFrame:
            seen.add(len(texts))
            return pd.DataFrame([(60, 200, 0, 0, 0, float(len(t))) for t in texts], columns=[c.split()[0] for c in quality_rules.BASE.split(", ")])

        return measure(text)

    monkeypatch.setattr(quality_rules.QualityModel, "columns", columns)
    docs = spark.createDataFrame([(i, prose(i + 1, 60)) for i in range(40)], "doc_id long, text string")
    model = fit_quality(docs, labelled(spark, [(i, i % 2, 0) for i in range(30)]), max_loss=1.0)
    assert seen.value == 30 and model.min_words == 20


def test_best_cut_equals_sorting(spark):
    rng = np.random.default_rng(3)
    for n, top, max_loss in ((400, 30, 0.001), (400, 30, 0.2), (3000, 10_000, 0.1), (5, 3, 1.0), (50, 1, 0.5)):
        kinds, ratio = rng.integers(0, 2, n), rng.integers(0, top, n) / 7 - 1.0
        ratio = ratio + kinds * 0.5
        want = best_threshold(ratio[kinds == 1], ratio[kinds == 0], max_loss)
        assert best_cut(spark.createDataFrame([(int(k), float(x)) for k, x in zip(kinds, ratio)], "kind int, ratio double"), max_loss) == want
    assert best_cut(spark.createDataFrame([(1, 0.5)], "kind int, ratio double"), 0.1) == float("-inf")


def test_importance_weights_and_top_k(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts, good_ids = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, good = np.zeros(1 << 16), np.zeros(1 << 16)
    for i, t in texts.items():
        np.add.at(raw, ngram_buckets(lower_tokens(t)), 1)
        if i in good_ids:
            np.add.at(good, ngram_buckets(lower_tokens(t)), 1)
    ratios = np.log((good + 1) / (good.sum() + 65536)) - np.log((raw + 1) / (raw.sum() + 65536))
    out = resample(docs, labels).collect()
    assert len(out) == len(texts)
    for r in out:
        assert abs(r.log_weight - ratios[ngram_buckets(lower_tokens(texts[r.doc_id]))].sum()) < 1e-2
    share = labels.where("quality = 1").count() / labels.count()
    assert sum(r.kept for r in out) == round(share * len(texts))
    assert min(r.gumbel_key for r in out if r.kept) > max(r.gumbel_key for r in out if not r.kept)


def test_importance_edges(spark):
    out = resample(messy(spark), labelled(spark, [(5, 1, 0), (7, 0, 0)]), share=0.5).collect()
    assert len(out) == len(MESSY) and sum(r.kept for r in out) >= round(0.5 * len(MESSY))
    assert len({r.gumbel_key for r in out if r.doc_id == 7}) == 1  # repeated rows tie
    assert resample(messy(spark).limit(0), labelled(spark, [])).count() == 0
    assert {r.log_weight for r in resample(messy(spark), labelled(spark, [])).collect()} == {0.0}


def test_kth_largest_equals_sorting(spark):
    keys = [(float(x),) for x in ([1.5] * 7 + list(range(9000)) + [1e9, -1e9] + [8999.25] * 5000)]
    df = spark.createDataFrame(keys, "k double")
    ordered = sorted((k[0] for k in keys), reverse=True)
    for k in (1, 2, 5000, 5003, 9000, len(keys)):
        assert kth_largest(df, "k", k) == ordered[k - 1]
    noise = [r.g for r in spark.range(20000).select(gumbel(1, F.col("id")).alias("g")).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.05 and abs(np.var(noise) - math.pi**2 / 6) < 0.1


def brute_counts(rows):
    counts = Counter()
    for i, t in rows:
        if crc32(str("" if i is None else i).encode()) % 10:
            counts.update([*lower_tokens(t), b""])
    return counts


def test_language_model_base_scores_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + MESSY
    out = score_documents(messy(spark, rows), known_words=6000).collect()  # words beyond the table take the join
    counts = brute_counts(rows)
    total, distinct = sum(counts.values()), len(counts)
    base = math.log10(total + 0.1 * (distinct + 1))
    want = Counter()
    for i, t in rows:
        words = [*lower_tokens(t), b""]
        want[i, crc32(str("" if i is None else i).encode()) % 10 == 0, len(words), sum(counts[w] > 0 for w in words), total, round(sum(math.log10(counts[w] + 0.1) - base for w in words), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert max(s := [r.score for r in out if r.doc_id == 7 and r.n_tokens == 61]) - min(s) < 1e-3  # repeated rows: equal but for rounding
    empty = score_documents(messy(spark).limit(0)).collect()
    assert empty == []


def test_every_training_row_is_learnt_in_every_round(spark, tmp_path):
    rows = [(i, prose(i, 899), i % 10 == 0) for i in range(400)]  # 324,000 training tokens; beyond 300,000 only a share was learnt

    class Words:
        total = 360 * 900

        @property
        def value(self):
            return self

        def read(self, words):
            with open(f"{tmp_path}/{os.getpid()}", "ab") as f:
                f.write(b" ".join(words) + b"\n")
            return np.array([crc32(w) % START for w in words], np.int32), None, []

    df = spark.createDataFrame(rows, "id long, text string, held_out boolean").repartition(3)
    _fit(df, Words(), Words(), Network(np.ones(WORDS), np.ones(START - WORDS)), rounds=2, rate=0.01)
    read = Counter(line.strip().decode() for f in tmp_path.iterdir() for line in open(f, "rb"))
    assert read == Counter({t: 2 for _, t, held_out in rows if not held_out})


def test_network_probabilities_and_carried_state():
    rng = np.random.default_rng(1)
    net = Network(rng.integers(1, 100, WORDS).astype(float), np.full(START - WORDS, 50.0))
    h = rng.normal(0, 1, (1, 16)).astype(np.float32)
    every = net.log_probability(np.repeat(h, START, axis=0), np.arange(START))
    assert abs(np.exp(every.astype(float)).sum() - 1) < 1e-3  # classes and words make one distribution
    docs = [rng.integers(0, START, n).astype(np.int32) for n in (1, 7, 200, 33, 32, 64, 1)]
    together = net.document_scores(docs)
    for d, s in zip(docs, together):
        h, total = np.zeros((1, 16), np.float32), 0.0
        for t in range(len(d)):
            h = net.step(np.array([START if t == 0 else d[t - 1]]), h)[0]
            total += float(net.log_probability(h, d[t : t + 1])[0])
        assert abs(total - s) < 1e-2
    before = net.document_scores([np.tile(np.array([5, 9, 4100]), 400).astype(np.int32)])[0]
    net.train([np.tile(np.array([5, 9, 4100]), 400).astype(np.int32)] * 16, 0.02)
    assert net.document_scores([np.tile(np.array([5, 9, 4100]), 400).astype(np.int32)])[0] > before / 2


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = Network(rng.integers(1, 100, WORDS).astype(float), np.full(START - WORDS, 50.0))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = np.array([[START, 3, 70], [4100, START, 8]]), np.array([[3, 70, 4100], [2, 8, -1]])

    def loss():
        h, total, n = np.zeros((2, 16)), 0.0, 0
        for t in range(3):
            h = net.step(x[:, t], np.where((x[:, t] == START)[:, None], 0, h))[0]
            ok = y[:, t] >= 0
            total -= net.log_probability(h[ok], y[ok, t]).sum()
            n += ok.sum()
        return total / n

    g = {}
    for name, (rows, part) in net._gradients(x, y, x == START, np.zeros((2, 16)))[0].items():
        g[name] = np.zeros_like(net.w[name])
        g[name][rows] = part
    for name, at in (("x", (START, 5)), ("x", (3, 40)), ("zr", (2, 3)), ("zr", (4, 20)), ("c", (1, 1)), ("b", 7), ("b", 40), ("k", (3, 64)), ("kb", 1), ("v", (1, 2, 6)), ("vb", (0, 8))):
        was, eps = net.w[name][at], 1e-5
        net.w[name][at] = was + eps
        up = loss()
        net.w[name][at] = was - eps
        down = loss()
        net.w[name][at] = was
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name

"""Search over rows whose keys repeat: every row answers once, with its own text, in all modes."""

import math
from collections import Counter

from pyspark.sql import functions as F

from textguard.functions.hashing import hash_embedding
from textguard.operators import search as K

ROWS = [("k", "alpha beta", "s1", "p"), ("k", "beta gamma gamma", "s1", "p"), ("k", "beta gamma gamma", "s1", "p"), ("k", "alpha beta", "s2", "p"), ("m", "delta", "s1", "p"),
        ("k", "alpha beta", "s1", "other"), (None, "beta", "s1", "p"), ("e", "", "s1", "p"), ("n", None, "s1", "p")]


def tables(spark, mode, top_k=9, text="beta gamma"):
    rows = [r for r in ROWS if mode == "bm25" or r[1] is not None]  # a null vector fails its requests
    corpus = spark.createDataFrame(rows, "doc_key string, text string, source string, project_id string").withColumn("vector", hash_embedding(F.col("text"), 8))
    queries = spark.createDataFrame([(1, "ann", "p", text, top_k, "vector")], "query_id long, principal_id string, project_id string, query string, top_k int, search_mode string")
    return queries, corpus.repartition(3)


def answers(df):
    return [(r["rank"], r["doc_key"], r["text"], r["source"], None if r["score"] is None else round(r["score"], 9)) for r in sorted(df.collect(), key=lambda r: r["rank"] or 0)]


def test_vector_rows_with_equal_keys(spark):
    import hashlib

    def vector(text):
        h = hashlib.sha256(text.encode()).digest()
        return [h[i % 32] / 255 * 2 - 1 for i in range(8)]

    queries, corpus = tables(spark, "vector")
    want = []
    for key, text, source, project in ROWS:
        if project == "p" and text is not None:
            d2 = sum((a - b) ** 2 for a, b in zip(vector(text), vector("beta gamma")))
            want.append((key, text, source, round(1 / (1 + d2), 9)))
    got = answers(K.vector_topk(queries, corpus, embed_dims=8))
    assert Counter(g[1:] for g in got) == Counter(want)
    assert [g[0] for g in got] == list(range(1, len(want) + 1)) and [g[4] for g in got] == sorted((w[3] for w in want), reverse=True)
    best = answers(K.vector_topk(tables(spark, "vector", top_k=2)[0], corpus, embed_dims=8))
    assert len(best) == 2 and [b[4] for b in best] == [g[4] for g in got[:2]]


def bm25(rows, text):
    docs = [(r, (r[1] or "").split()) for r in rows]
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    out = []
    for r, tokens in docs:
        score = 0.0
        for term in text.split():
            df = sum(term in t for _, t in docs)
            tf = tokens.count(term)
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean)) if tf else 0
        if score and r[3] == "p":
            out.append((r[0], r[1], r[2], round(score, 9)))
    return out


def test_bm25_rows_with_equal_keys(spark):
    queries, corpus = tables(spark, "bm25")
    index = K.build_text_index(corpus)
    assert (index.n_docs, index.avg_len) == (len(ROWS), sum(len((r[1] or "").split()) for r in ROWS) / len(ROWS))
    got = answers(K.bm25_topk(queries, corpus, index))
    want = bm25(ROWS, "beta gamma")
    assert Counter(g[1:] for g in got) == Counter(want) and [g[0] for g in got] == list(range(1, len(want) + 1))
    top = answers(K.bm25_topk(tables(spark, "bm25", top_k=1)[0], corpus, index))
    assert [t[1:3] for t in top] == [("k", "beta gamma gamma")]


def test_hybrid_rows_with_equal_keys(spark):
    queries, corpus = tables(spark, "hybrid")
    got = answers(K.hybrid_topk(queries, corpus, K.build_text_index(corpus), embed_dims=8))
    rows = [r for r in ROWS if r[3] == "p" and r[1] is not None]
    assert Counter(g[1:4] for g in got) == Counter(r[:3] for r in rows)


def test_postings_of_a_document_stay_where_it_was_read(spark):
    """No posting is shuffled: a document's lie side by side in one file; equal rows share theirs."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, f"p{i % 3}", " ".join(words[: 1 + i % 8] * 2), "s") for i in range(60)] + [(7, "p1", " ".join(words * 2), "s"), (None, "p0", None, "s"), (99, "p0", "", "s")]
    corpus = spark.createDataFrame(rows, "doc_key long, project_id string, text string, source string").repartition(4)
    index = K.build_text_index(corpus)
    files = index.postings.withColumn("file", F.input_file_name()).groupBy("doc_key", "_tg_row", "project_id").agg(F.count_distinct("file").alias("files"), F.count_distinct("term").alias("terms"),
                                                                          F.max("copies").alias("copies"), F.max("dl").alias("dl"), F.max("tf").alias("tf")).collect()
    assert len(files) == 62 and all(r.files == 1 for r in files)
    for r in files:
        n = 1 + r.doc_key % 8 if r.doc_key is not None and r.doc_key != 99 else 0
        assert (r.terms, r.dl, r.tf) == (n, 2 * n, 2 if n else 1)
        assert r.copies == (2 if r.doc_key == 7 else 1)
    assert index.n_docs == 63
    assert {r.term: r.df for r in index.doc_freq.collect()} == {w: sum(i % 8 >= k for i in range(60)) + 1 for k, w in enumerate(words)}

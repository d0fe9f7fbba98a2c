"""Queries for retrieval: hash embedding (K1), project scope (K2), vector top-k (K3-K6),
BM25 top-k and hybrid RRF (K7, K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions.hashing import hash_embedding
from textguard.operators import search as K
from textguard.plans.registry import query
from textguard.sources.tables import read_table

GRANTED = [f"p{i}" for i in range(9)]  # the analyst may search p0..p8; p9 queries are refused
_GRANTED_SQL = "(" + ", ".join(f"'{p}'" for p in GRANTED) + ")"
TOP_K = 5
_TOK = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def corpus(spark, sf_dir):
    """Corpus rows: embeddings joined with documents on vec_id = doc_id; project = 'p' || label."""
    e = read_table(spark, sf_dir, "embeddings")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return e.join(d, e["vec_id"] == d["doc_id"]).select(
        F.col("doc_id"), F.col("embedding").alias("vector"), "text", "source",
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("project_id"))


def all_documents(spark, sf_dir):
    """Every document as a corpus row: project by id, vector from its own text (K1, 64 dimensions)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", hash_embedding(F.col("text"), 64).alias("vector"), "text", "source",
                    F.concat(F.lit("p"), (F.col("doc_id") % 10).cast("string")).alias("project_id"))


def grants(spark):
    return spark.createDataFrame([("analyst", p) for p in GRANTED], "principal_id string, project_id string")


def _out(df, with_source: bool = False):
    cols = [F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"),
            F.col("doc_id").cast("long").alias("doc_id")]
    if with_source:
        cols.append(F.col("source"))
    cols += [F.round("score", 6).alias("score"), F.col("error.code").alias("error_code")]
    return df.select(*cols)


@query("hash_embed", (
    "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents) "
    "SELECT doc_id, CAST(i AS BIGINT) AS dim, round((('0x' || substr(h, (i % 32) * 2 + 1, 2))::INTEGER / 255.0) * 2.0 - 1.0, 9) AS value "
    "FROM h, range(0, 32) r(i)"
))
def hash_embed(spark, sf_dir):
    """K1: deterministic 32-dimension hash embedding of every document (long form)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", hash_embedding(F.col("text"), 32).alias("v"))
    return d.select("doc_id", F.posexplode("v").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long"), F.round("value", 9).alias("value"))


_L2 = "list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - ok.qv[i]) * (c.v[i] - ok.qv[i])))"


def _vec_ctes(scale: str = "", text: str = "d.text") -> str:
    v = "CAST(e.embedding AS DOUBLE[])" if not scale else f"list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * {scale})"
    return (
        f"WITH corpus AS (SELECT d.doc_id, d.source, {text} AS text, 'p' || e.label AS project_id, {v} AS v "
        "  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id), "
        f"q AS (SELECT vec_id AS query_id, 'p' || label AS project_id, {v} AS qv FROM embeddings e WHERE vec_id % 20 = 0), "
        f"ok AS (SELECT * FROM q WHERE project_id IN {_GRANTED_SQL}), "
        f"s AS (SELECT ok.query_id, c.project_id, c.doc_id, c.source, c.text, {_L2} AS d2 FROM ok JOIN corpus c ON c.project_id = ok.project_id), "
        "r AS (SELECT *, 1.0 / (1.0 + greatest(d2, 0.0)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d2, source, doc_id) AS rank FROM s) "
    )


_REFUSED = (f"UNION ALL SELECT CAST(query_id AS BIGINT), NULL, NULL, NULL, NULL, 'project_not_authorized' FROM q WHERE project_id NOT IN {_GRANTED_SQL}")
_ROWS = ("SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, doc_id, source, round(score, 6) AS score, "
         "CAST(NULL AS VARCHAR) AS error_code FROM r WHERE rank <= 5 ")
_FAILED = "UNION ALL SELECT DISTINCT CAST(query_id AS BIGINT), NULL::BIGINT, NULL::BIGINT, NULL, NULL, 'knowledge_unavailable' FROM r WHERE "


def _vector_queries(spark, sf_dir, scale: float | None = None):
    """Every vector whose id is divisible by 20 searches its label's project."""
    vec = F.col("embedding").cast("array<double>")
    if scale:
        vec = F.transform(vec, lambda x: x * F.lit(scale))
    return read_table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").cast("long").alias("query_id"), F.lit("analyst").alias("principal_id"),
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("project_id"),
        F.concat(F.lit("nearest to vector "), F.col("vec_id").cast("string")).alias("query"),
        F.lit(TOP_K).alias("top_k"), F.lit("vector").alias("search_mode"), vec.alias("qvec"))


@query("vector_topk", f"{_vec_ctes()}{_ROWS}{_REFUSED}")
def vector_topk(spark, sf_dir):
    """K2/K3: every 20th vector searches its own project (top 5, squared L2);
    queries of p9 are outside the analyst's grants and return project_not_authorized."""
    res = K.vector_topk(_vector_queries(spark, sf_dir), corpus(spark, sf_dir), key_col="doc_id", grants=grants(spark))
    return _out(res, with_source=True)


@query("vector_far", f"{_vec_ctes('10000.0')}SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, doc_id FROM r WHERE rank <= 5")
def vector_far(spark, sf_dir):
    """K3 at large distances: vectors scaled by 10,000, ranked on the distance itself."""
    c = corpus(spark, sf_dir).withColumn("vector", F.transform(F.col("vector").cast("array<double>"), lambda x: x * 10000.0))
    res = K.vector_topk(_vector_queries(spark, sf_dir, 10000.0), c, key_col="doc_id", grants=grants(spark))
    return _out(res.filter(F.col("error").isNull())).select("query_id", "rank", "doc_id")


# Project p3 holds vectors with a NaN, p5 vectors of another width.
_BAD = "query_id IN (SELECT query_id FROM r WHERE project_id IN ('p3', 'p5') AND doc_id % 7 = 0)"


@query("score_hygiene", f"{_vec_ctes()}{_ROWS}AND NOT {_BAD} {_FAILED}{_BAD} {_REFUSED}")
def score_hygiene(spark, sf_dir):
    """K5: a project with a NaN or a vector of another width fails its requests, whatever rank the row has."""
    odd = F.col("doc_id") % 7 == 0
    v = F.col("vector").cast("array<double>")
    broken = (F.when(odd & (F.col("project_id") == "p3"), F.concat(F.array(F.lit(float("nan"))), F.slice(v, 2, 63)))
              .when(odd & (F.col("project_id") == "p5"), F.slice(v, 1, 63)).otherwise(v))
    res = K.vector_topk(_vector_queries(spark, sf_dir), corpus(spark, sf_dir).withColumn("vector", broken), key_col="doc_id", grants=grants(spark))
    return _out(res, with_source=True)


_LONG_SQL = "CASE WHEN d.doc_id % 40 = 0 THEN repeat('x', 102401) WHEN d.doc_id % 40 = 1 THEN repeat('x', 102400) ELSE d.text END"
_TOO_LONG = "query_id IN (SELECT query_id FROM r WHERE rank <= 5 AND strlen(text) > 102400)"


@query("result_caps", f"{_vec_ctes(text=_LONG_SQL)}{_ROWS}AND NOT {_TOO_LONG} {_FAILED}{_TOO_LONG} {_REFUSED}")
def result_caps(spark, sf_dir):
    """K6: a result text of 102,401 bytes fails its request, one of 102,400 bytes does not."""
    d = F.col("doc_id") % 40
    text = F.when(d == 0, F.repeat(F.lit("x"), 102401)).when(d == 1, F.repeat(F.lit("x"), 102400)).otherwise(F.col("text"))
    res = K.vector_topk(_vector_queries(spark, sf_dir), corpus(spark, sf_dir).withColumn("text", text), key_col="doc_id", grants=grants(spark))
    return _out(res, with_source=True)


@query("result_postfilter", f"{_vec_ctes()}SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, doc_id, md5(text) AS text_md5 FROM r WHERE rank <= 5")
def result_postfilter(spark, sf_dir):
    """K4: every row stands in a second project too, with the same key and vector; only the request's project may answer."""
    c = corpus(spark, sf_dir)
    other = c.withColumn("project_id", F.concat(F.lit("q"), F.col("project_id"))).withColumn("text", F.lit("of another project"))
    res = K.vector_topk(_vector_queries(spark, sf_dir), c.unionByName(other), key_col="doc_id", grants=grants(spark))
    return res.filter(F.col("error").isNull()).select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("chunk_topk", f"{_vec_ctes()}SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, source AS doc_key, round(score, 6) AS score, md5(text) AS text_md5 "
       "FROM r WHERE rank <= 5")
def chunk_topk(spark, sf_dir):
    """K3/K4 over rows whose keys repeat: the key is the source, which many rows of a project share; each answers with its own text."""
    c = corpus(spark, sf_dir).withColumn("doc_key", F.col("source"))
    res = K.vector_topk(_vector_queries(spark, sf_dir), c, key_col="doc_key", grants=grants(spark))
    return res.filter(F.col("error").isNull()).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_key", F.round("score", 6).alias("score"), F.md5("text").alias("text_md5"))


def _bench_queries(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.lit("analyst").alias("principal_id"),
                    F.concat(F.lit("p"), (F.col("item_id") % 10).cast("string")).alias("project_id"),
                    F.col("text").alias("query"), F.lit(TOP_K).alias("top_k"), F.lit("hybrid").alias("search_mode"))


_BM25_CTE = (
    "corpus AS (SELECT d.doc_id, d.source, d.text, 'p' || (d.doc_id % 10) AS project_id, "
    "  list_transform(range(0, 64), lambda i: (('0x' || substr(sha256(d.text), (i % 32) * 2 + 1, 2))::INTEGER / 255.0) * 2.0 - 1.0) AS v, "
    f"  {_TOK.format(x='d.text')} AS toks FROM documents d), "
    "stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM corpus), "
    "post AS (SELECT doc_id, project_id, dl, t AS term, count(*) AS tf FROM "
    "  (SELECT doc_id, project_id, len(toks) AS dl, unnest(toks) AS t FROM corpus) GROUP BY ALL), "
    "dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), "
    "q AS (SELECT item_id AS query_id, 'p' || (item_id % 10) AS project_id, text AS query FROM benchmark), "
    f"ok AS (SELECT * FROM q WHERE project_id IN {_GRANTED_SQL}), "
    "qt AS (SELECT query_id, project_id, t AS term, count(*) AS qtf FROM "
    f"  (SELECT query_id, project_id, unnest({_TOK.format(x='query')}) AS t FROM ok) GROUP BY ALL), "
    "bm AS (SELECT qt.query_id, p.doc_id, sum(qt.qtf * ln(1 + (stats.n - dfs.df + 0.5) / (dfs.df + 0.5)) * p.tf * 2.2 "
    "  / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / stats.avgdl))) AS score "
    "  FROM qt JOIN dfs ON dfs.term = qt.term JOIN post p ON p.term = qt.term AND p.project_id = qt.project_id CROSS JOIN stats "
    "  GROUP BY qt.query_id, p.doc_id), "
    "bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm) "
)
_ERRS = ("UNION ALL SELECT CAST(query_id AS BIGINT), NULL, NULL, NULL, 'project_not_authorized' FROM q "
         f"WHERE project_id NOT IN {_GRANTED_SQL}")


@query("bm25_topk", (
    f"WITH {_BM25_CTE}"
    "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score, "
    f"CAST(NULL AS VARCHAR) AS error_code FROM bmr WHERE rank <= 5 {_ERRS}"
))
def bm25_topk(spark, sf_dir):
    """K7 (text half): BM25 (k1 = 1.2, b = 0.75) top 5 per benchmark query inside its project, over all documents."""
    c = all_documents(spark, sf_dir)
    res = K.bm25_topk(_bench_queries(spark, sf_dir), c, K.build_text_index(c, key_col="doc_id"), key_col="doc_id", grants=grants(spark))
    return _out(res)


_QVEC = ("list_transform(range(0, 64), lambda i: (('0x' || substr(sha256(query), (i % 32) * 2 + 1, 2))::INTEGER / 255.0) * 2.0 - 1.0)")


@query("hybrid_rrf", (
    f"WITH {_BM25_CTE}, "
    f"ok2 AS (SELECT query_id, project_id, {_QVEC} AS qv FROM ok), "
    f"vs AS (SELECT ok.query_id, c.doc_id, c.source, {_L2} AS d2 FROM ok2 ok JOIN corpus c ON c.project_id = ok.project_id), "
    "vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, source, doc_id) AS rank FROM vs), "
    "f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, "
    "  coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0) AS score "
    "  FROM (SELECT * FROM vr WHERE rank <= 5) a FULL OUTER JOIN (SELECT * FROM bmr WHERE rank <= 5) b "
    "  ON a.query_id = b.query_id AND a.doc_id = b.doc_id), "
    "fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) "
    "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, fr.doc_id, d.source, round(greatest(score, 0.0), 6) AS score, "
    f"CAST(NULL AS VARCHAR) AS error_code FROM fr JOIN documents d ON d.doc_id = fr.doc_id WHERE rank <= 5 {_ERRS.replace('NULL, NULL, NULL,', 'NULL, NULL, NULL, NULL,')}"
))
def hybrid_rrf(spark, sf_dir):
    """K7/K8: reciprocal-rank fusion (k = 60) of the vector ranking (hash-embedded texts, 64 dims) and the BM25
    ranking, each cut at top_k, over all documents."""
    c = all_documents(spark, sf_dir)
    idx = K.build_text_index(c, key_col="doc_id")
    res = K.hybrid_topk(_bench_queries(spark, sf_dir), c, idx, key_col="doc_id", grants=grants(spark), embed_dims=64)
    return _out(res, with_source=True)


@query("hybrid_without_index", (
    "SELECT CAST(item_id AS BIGINT) AS query_id, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS doc_id, "
    "CAST(NULL AS DOUBLE) AS score, CASE WHEN 'p' || (item_id % 10) IN " + _GRANTED_SQL +
    " THEN 'knowledge_hybrid_unavailable' ELSE 'project_not_authorized' END AS error_code FROM benchmark"
))
def hybrid_without_index(spark, sf_dir):
    """K7: hybrid search without a text index fails per query; it never falls back to vector search."""
    res = K.hybrid_topk(_bench_queries(spark, sf_dir), all_documents(spark, sf_dir), None, key_col="doc_id", grants=grants(spark))
    return _out(res)

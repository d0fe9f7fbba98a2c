"""Project-scoped retrieval (K1-K8): vector top-k, BM25 top-k and reciprocal-rank fusion.

Queries are rows ``(query_id, principal_id, project_id, query, top_k, search_mode[, qvec])`` with
ids of any type; equal ids of different requests stay apart. The corpus is
``(key, vector, text, source, project_id)``; keys may repeat: rows are told apart by ``_row_print``, and equal
rows each take a rank of their own.

Plan shape (exact search, no approximate index; nothing is collected, and no job runs while the plan
is built, except that ``build_text_index`` writes its tables and BM25 counts the terms of the requests):

* authorisation is a join with the grants table (K2), validation is row-local (V6, V7);
* vector search deals corpus rows and queries by (project, salt). A project's queries come to every
  salt once, its corpus rows to one salt, so a project with a third of all rows is spread over all
  partitions. Inside a partition the queries are held, and the corpus streams past them in Arrow
  batches; no (query, row) pair becomes a row, and at most k rows per query leave a partition;
* rankings compare the squared distance itself, with exact ties in the order of source and key;
* BM25 joins the query's terms, with their stored document frequencies, to the stored postings, which lie document
  by document: neither building nor reading them shuffles a posting, and scores are summed before their shuffle;
* text is joined onto the ranked rows only. Result hygiene (K5) and caps (K6) are the same in all modes.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textguard import errors as E
from textguard.functions.hashing import hash_embedding
from textguard.operators import validate as V
from textguard.session import checkpoint_dir

MAX_TOP_K = 50
MAX_FIELD_BYTES = 100 * 1024
MAX_RESULT_BYTES = 2 * 1024 * 1024
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
REQUIRED = ("text", "source", "project_id")
QUERY_BLOCK = 256            # queries scored together against one Arrow batch of the corpus
INDEX_BLOCK = 256            # documents whose terms are counted together
BROADCAST_TERMS = 1_000_000  # up to this many terms of requests are sent to every task


def tokenize(text: Column) -> Column:
    """Lower-case, split on anything that is not a letter or digit, drop empty tokens."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def _row_print() -> Column:
    """Tells rows that share a key and a project apart; rows that also share it have the same text and source."""
    return F.xxhash64("text", "source").alias("_tg_row")


def check_queries(queries: DataFrame, grants: DataFrame | None, allowed_projects=None,
                  principal_col: str = "principal_id") -> DataFrame:
    """V6/V7 + K2: add ``error``; authorised = (principal, project) granted and project configured."""
    q = queries
    if grants is not None:
        g = grants.select(F.col("principal_id").alias("_tg_gp"), F.col("project_id").alias("_tg_gproj")).distinct()
        q = q.join(g, (q[principal_col] == g["_tg_gp"]) & (q["project_id"] == g["_tg_gproj"]), "left")
        granted = F.col("_tg_gp").isNotNull()
    else:
        granted = F.lit(True)
    if allowed_projects is not None:
        granted = granted & F.col("project_id").isin(*sorted(allowed_projects))
    mode = F.col("search_mode") if "search_mode" in q.columns else F.lit("vector")
    err = E.first_error(
        (~V.text_ok(F.col("query")), E.VALIDATION_ERROR),
        (~V.project_id_ok(F.col("project_id")), E.VALIDATION_ERROR),
        (~V.top_k_ok(F.col("top_k"), queries.schema["top_k"].dataType), E.VALIDATION_ERROR),
        (~V.search_mode_ok(mode), E.VALIDATION_ERROR),
        (~granted, E.PROJECT_NOT_AUTHORIZED),
    )
    return q.withColumn("error", err).drop("_tg_gp", "_tg_gproj")


def _requests(queries: DataFrame, grants, allowed_projects) -> DataFrame:
    """Checked queries with ``_tg_rk``, a digest of the whole request. Equal requests share it, and their result."""
    q = check_queries(queries, grants, allowed_projects)
    return q.withColumn("_tg_rk", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in queries.columns])), 256))


def _ranked(scored: DataFrame, order: list[Column]) -> DataFrame:
    """Best ``top_k`` rows per request; the constant limit lets Spark cut each partition before the shuffle."""
    w = Window.partitionBy("_tg_rk").orderBy(*order)
    rows = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= MAX_TOP_K)
    return rows.filter(F.col("rank") <= F.col("top_k"))


class _Nearest:
    """Running best k corpus rows of one project's queries."""

    def __init__(self):
        self.names, self.vectors, self.ks = [], [], []
        self.best = self.matrix = None

    def add(self, name, vector, k):
        self.names.append(name)
        self.vectors.append(vector)
        self.ks.append(k)

    def see(self, keys: list, prints: list, sources: list, vectors: list) -> None:
        if self.best is None:
            self.best = [[] for _ in self.names]
            self.bad = [None] * len(self.names)
            widths = [len(v) if v is not None else -1 for v in self.vectors]
            self.groups = {w: [i for i, x in enumerate(widths) if x == w] for w in set(widths)}
            self.matrix = {w: np.array([self.vectors[i] for i in own], float).reshape(len(own), max(w, 0)) for w, own in self.groups.items()}
        own_widths = np.array([len(v) if v is not None else -2 for v in vectors])
        for width, queries in self.groups.items():
            fit = np.flatnonzero(own_widths == width)
            if len(fit) < len(vectors):  # a vector of another width is a bad row
                at = int(np.flatnonzero(own_widths != width)[0])
                for i in queries:
                    self.bad[i] = self.bad[i] or (keys[at], prints[at], sources[at])
            if not len(fit) or width < 0:
                continue
            rows = np.array([vectors[j] for j in fit], float).reshape(len(fit), width)
            for b in range(0, len(queries), QUERY_BLOCK):
                block = self.matrix[width][b : b + QUERY_BLOCK]
                d2 = np.zeros((len(fit), len(block)))
                for i in range(width):  # one dimension after another: the same sums as a fold in SQL
                    diff = rows[:, i : i + 1] - block[None, :, i]
                    d2 += diff * diff
                for j, i in enumerate(queries[b : b + QUERY_BLOCK]):
                    d = d2[:, j]
                    good = ~np.isnan(d)
                    if not good.all():
                        at = fit[int(np.flatnonzero(~good)[0])]
                        self.bad[i] = self.bad[i] or (keys[at], prints[at], sources[at])
                    k, best = self.ks[i], self.best[i]
                    limit = best[k - 1][0] if len(best) >= k else np.inf
                    near = np.flatnonzero(good & (d <= limit))
                    if len(near) > k:  # all rows up to the k-th distance of this batch, then the exact order
                        near = near[d[near] <= np.partition(d[near], k - 1)[k - 1]]
                    best += [(float(d[x]), sources[fit[x]] or "", keys[fit[x]], prints[fit[x]]) for x in near]
                    best.sort()
                    del best[k:]

    def rows(self):
        for i, name in enumerate(self.names):
            if self.best is None:
                return
            for d, source, key, row in self.best[i]:
                yield name, self.ks[i], key, row, source, d, False
            if self.bad[i] is not None:
                yield name, self.ks[i], *self.bad[i], None, True


def vector_candidates(requests: DataFrame, corpus: DataFrame, key_col: str, salts: int | None = None) -> DataFrame:
    """K3: per request and partition the best k corpus rows of its project: _tg_rk, top_k, key, _tg_row, source, d2, bad.

    ``bad`` rows (a vector of another width, or a distance that is no number) say that the request must fail (K5).
    """
    spark = corpus.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_type = corpus.schema[key_col].dataType
    queries = requests.select("_tg_rk", "project_id", F.col("top_k").cast("int").alias("top_k"), F.col("qvec").cast("array<double>").alias("vector")).distinct()
    queries = queries.withColumn("_tg_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = corpus.select(F.col(key_col).alias("_tg_key"), _row_print(), "project_id", "source", F.explode(F.array(F.col("vector").cast("array<double>"))).alias("vector"))
    # (a generator's column has no constraint: Catalyst fails on those of embeddings computed in the same plan, in the union below)
    rows = rows.withColumn("_tg_salt", F.pmod(F.xxhash64("_tg_key", "_tg_row"), F.lit(salts)).cast("int"))
    rows = rows.join(requests.select("project_id").distinct(), "project_id", "left_semi")  # projects that nobody searches
    both = queries.unionByName(rows, allowMissingColumns=True).repartition(salts, "project_id", "_tg_salt").sortWithinPartitions(
        "project_id", "_tg_salt", F.col("_tg_rk").asc_nulls_last())  # a project's queries first
    schema = T.StructType([T.StructField("_tg_rk", T.StringType()), T.StructField("top_k", T.IntegerType()), T.StructField(key_col, key_type),
                           T.StructField("_tg_row", T.LongType()), T.StructField("source", T.StringType()), T.StructField("d2", T.DoubleType()), T.StructField("bad", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def search(batches):
        group, state = None, None

        def out(state):
            found = list(state.rows())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            seen: list[int] = []

            def flush():
                if seen:
                    state.see(*([col[c][i] for i in seen] for c in ("_tg_key", "_tg_row", "source", "vector")))
                    seen.clear()

            for i in range(batch.num_rows):
                here = (col["project_id"][i], col["_tg_salt"][i])
                if here != group:
                    if state is not None:
                        flush()
                        yield out(state)
                    group, state = here, _Nearest()
                if col["_tg_rk"][i] is not None:
                    state.add(col["_tg_rk"][i], col["vector"][i], col["top_k"][i])
                else:
                    seen.append(i)
            if state is not None:
                flush()
        if state is not None:
            yield out(state)

    return both.mapInArrow(search, schema)


def _finish(requests: DataFrame, ranked: DataFrame, bad: DataFrame | None, corpus: DataFrame, key_col: str) -> DataFrame:
    """Join text and source onto the ranked rows; a request with a bad row, a field or a total beyond the caps fails
    as a whole (K5, K6). One error row per failed request; ids and columns keep their types."""
    texts = corpus.select(F.col(key_col).alias("_tg_key"), F.col("project_id").alias("_tg_project"), _row_print(), "text", F.col("source").alias("_tg_source"))
    project = requests.select("_tg_rk", "project_id").distinct()
    found = ranked.select("_tg_rk", "rank", F.col(key_col).alias("_tg_want"), F.col("_tg_row").alias("_tg_print"), "score").join(project, "_tg_rk")
    wanted = found.select(F.col("_tg_want").alias("_tg_k"), F.col("_tg_print").alias("_tg_p"), F.col("project_id").alias("_tg_of")).distinct()
    texts = wanted.join(texts, F.col("_tg_key").eqNullSafe(F.col("_tg_k")) & (F.col("_tg_row") == F.col("_tg_p")) & (F.col("_tg_project") == F.col("_tg_of")))
    texts = texts.groupBy("_tg_k", "_tg_p", "_tg_of").agg(F.first("text").alias("text"), F.first("_tg_source").alias("source"))  # equal rows: one text
    found = found.join(texts, F.col("_tg_want").eqNullSafe(F.col("_tg_k")) & (F.col("_tg_print") == F.col("_tg_p")) & (F.col("project_id") == F.col("_tg_of"))).select(
        "_tg_rk", "rank", F.col("_tg_want").alias(key_col), "text", "source", "score")
    size = F.coalesce(F.octet_length("text"), F.lit(0)), F.coalesce(F.octet_length("source"), F.lit(0))
    state = found.groupBy("_tg_rk").agg((F.max(F.greatest(*size)) > MAX_FIELD_BYTES).alias("big"), (F.sum(size[0] + size[1]) > MAX_RESULT_BYTES).alias("much"))
    fails = state.where("big OR much").select("_tg_rk")
    if bad is not None:
        fails = fails.unionByName(bad.select("_tg_rk"))
    fails = fails.distinct().withColumn("failed", F.lit(True))
    checked = requests.select("query_id", "_tg_rk", "error").join(fails, "_tg_rk", "left")
    checked = checked.withColumn("error", F.when(F.col("error").isNull() & F.col("failed"), E.error(E.KNOWLEDGE_UNAVAILABLE)).otherwise(F.col("error")))
    rows = checked.filter(F.col("error").isNull()).select("query_id", "_tg_rk", "error").join(found, "_tg_rk")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields}
    failed = checked.filter(F.col("error").isNotNull())
    out = ["query_id", "rank", key_col, "text", "source", "score", "error"]
    return rows.select(*out).unionByName(failed.select("query_id", *[none[c] for c in out[1:-1]], "error"))


def _all_failed(requests: DataFrame, code: str, corpus: DataFrame | None, key_col: str) -> DataFrame:
    """Every request that passed the checks fails with ``code``."""
    key_type = corpus.schema[key_col].dataType if corpus is not None and key_col in corpus.columns else T.LongType()
    return requests.select("query_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast(key_type).alias(key_col), F.lit(None).cast("string").alias("text"),
                           F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("score"), F.coalesce(F.col("error"), E.error(code)).alias("error"))


def _nearest(requests: DataFrame, corpus: DataFrame, key_col: str) -> tuple[DataFrame, DataFrame]:
    found = vector_candidates(requests.filter(F.col("error").isNull()), corpus, key_col)
    score = (F.lit(1.0) / (F.lit(1.0) + F.greatest(F.col("d2"), F.lit(0.0)))).alias("score")
    good = found.filter(~F.col("bad")).select("_tg_rk", "top_k", key_col, "_tg_row", "source", "d2", score)
    return _ranked(good, [F.col("d2"), F.col("source"), F.col(key_col), F.col("_tg_row")]), found.filter("bad").select("_tg_rk")


def vector_topk(queries: DataFrame, corpus: DataFrame, *, key_col: str = "doc_key", grants: DataFrame | None = None,
                allowed_projects=None, embed_dims: int | None = None) -> DataFrame:
    """Top-k nearest corpus rows per authorised query; one error row per rejected query.

    Queries carry ``qvec`` or, with ``embed_dims``, are embedded with the hash embedder (K1).
    Output: ``query_id, rank, key, text, source, score, error``.
    """
    requests = _requests(queries, grants, allowed_projects)
    if any(c not in corpus.columns for c in REQUIRED + ("vector",)):  # K4: schema check, no silent fallback
        return _all_failed(requests, E.KNOWLEDGE_UNAVAILABLE, corpus, key_col)
    if embed_dims:
        requests = requests.withColumn("qvec", hash_embedding(F.col("query"), embed_dims))
    ranked, bad = _nearest(requests, corpus, key_col)
    return _finish(requests, ranked, bad, corpus, key_col)


@dataclass
class TextIndex:
    """The full-text index: stored tables of postings and document frequencies, and corpus statistics."""
    postings: DataFrame   # key, _tg_row, project_id, copies, term, tf, dl; those of a document side by side
    doc_freq: DataFrame   # term, df
    n_docs: int
    avg_len: float
    key_col: str


def _count_terms(schema: pa.Schema):
    """Rows (..., toks) to one row per document and distinct term; a document without tokens stays as one null-term row."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_BLOCK):
                block = batch.slice(at, INDEX_BLOCK)
                toks = block.column("toks")
                dl = pc.list_value_length(toks).to_numpy(zero_copy_only=False)
                coded = pc.dictionary_encode(toks.flatten())
                width = max(1, len(coded.dictionary))
                pairs, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                empty = np.flatnonzero(dl == 0)
                doc = np.concatenate([pairs // width, empty])
                code = pa.array(np.concatenate([pairs % width, np.zeros(len(empty), np.int64)]), mask=np.arange(len(doc)) >= len(pairs))
                found = {"term": coded.dictionary.take(code), "tf": pa.array(np.concatenate([tf, np.ones(len(empty), np.int64)])), "dl": pa.array(dl[doc])}
                yield pa.RecordBatch.from_arrays([(found[f.name] if f.name in found else block.column(f.name).take(pa.array(doc))).cast(f.type) for f in schema], schema=schema)

    return run


def build_text_index(corpus: DataFrame, key_col: str = "doc_key") -> TextIndex:
    """Tokenise once, count every document's terms where it is read, and store the postings and the document
    frequencies in the shared folder. Only narrow rows (keys, and counts per term and task) are shuffled."""
    spark = corpus.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"text-index-{uuid.uuid4().hex}")

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    row = [key_col, "_tg_row", "project_id"]
    docs = corpus.select(key_col, _row_print(), "project_id", "text")
    again = docs.groupBy(F.col(key_col).alias("_tg_k"), F.col("_tg_row").alias("_tg_r"), F.col("project_id").alias("_tg_p")).agg(F.count("*").alias("copies"))
    again = table(again.where("copies > 1"), "copies")  # equal rows share postings
    same = F.col(key_col).eqNullSafe(F.col("_tg_k")) & (F.col("_tg_row") == F.col("_tg_r")) & F.col("project_id").eqNullSafe(F.col("_tg_p"))
    rows = docs.join(again, same, "left_anti").withColumn("copies", F.lit(1).cast("long"))
    if again.head(1):
        rows = rows.unionByName(docs.join(again, same).groupBy(*row).agg(F.first("text").alias("text"), F.first("copies").alias("copies")))
    rows = rows.select(*row, "copies", F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("toks"))
    # A document without tokens stays as one null-term row: it counts in N and in the average length.
    schema = T.StructType([*(rows.schema[c] for c in [*row, "copies"]), *T.StructType.fromDDL("dl int, term string, tf long").fields])
    postings = table(rows.mapInArrow(_count_terms(to_arrow_schema(schema)), schema), "postings")
    doc_freq = table(postings.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("copies").alias("df")), "doc-freq")
    tokens = F.sum(F.when(F.col("term").isNotNull(), F.col("tf") * F.col("copies")))
    stats = corpus.agg(F.count("*").alias("n")).crossJoin(postings.agg(tokens.alias("tokens"))).first()  # one row each
    mean = (stats["tokens"] or 0) / stats["n"] if stats["n"] else 0.0
    return TextIndex(postings, doc_freq, int(stats["n"]), float(mean), key_col)


def bm25_scores(requests: DataFrame, index: TextIndex, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Sum over query tokens (with multiplicity) of idf * tf(k1+1) / (tf + k1(1 - b + b dl/avgdl)),
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); only documents of the query's project."""
    terms = requests.select("_tg_rk", "project_id", F.col("top_k").cast("int").alias("top_k"), "query").distinct()
    terms = terms.select("_tg_rk", "project_id", "top_k", F.explode(tokenize(F.col("query"))).alias("term"))
    terms = terms.groupBy("_tg_rk", "project_id", "top_k", "term").agg(F.count("*").alias("qtf"))
    idf = F.log(1.0 + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.join(index.doc_freq, "term").withColumn("idf", idf)
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS  # only chooses the join
    hits = index.postings.join(terms.hint("broadcast" if few else "shuffle_hash"), ["term", "project_id"])
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / F.lit(index.avg_len if index.avg_len else 1.0))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return hits.groupBy(index.key_col, "_tg_row", "copies", "_tg_rk", "top_k").agg(F.sum(part).alias("score"))


def _best_texts(requests: DataFrame, index: TextIndex) -> DataFrame:
    """BM25 ranking; sums of floats may differ in the last bits between runs, so ranks compare 9 places."""
    scored = bm25_scores(requests.filter(F.col("error").isNull()), index)
    best = _ranked(scored, [F.round("score", 9).desc(), F.col(index.key_col), F.col("_tg_row")]).drop("rank")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies").cast("int"), "top_k"))))  # equal rows take a rank each
    return _ranked(best, [F.round("score", 9).desc(), F.col(index.key_col), F.col("_tg_row")])


def bm25_topk(queries: DataFrame, corpus: DataFrame, index: TextIndex | None, *, key_col: str = "doc_key",
              grants: DataFrame | None = None, allowed_projects=None) -> DataFrame:
    """Top-k BM25 documents per authorised query: ``query_id, rank, key, text, source, score, error``."""
    requests = _requests(queries, grants, allowed_projects)
    if index is None:
        return _all_failed(requests, E.KNOWLEDGE_HYBRID_UNAVAILABLE, corpus, key_col)
    return _finish(requests, _best_texts(requests, index), None, corpus, key_col)


def hybrid_topk(queries: DataFrame, corpus: DataFrame, index: TextIndex | None, *, key_col: str = "doc_key",
                grants: DataFrame | None = None, allowed_projects=None, embed_dims: int = 32,
                rrf_k: int = RRF_K) -> DataFrame:
    """K7/K8: top_k by reciprocal-rank fusion of the vector and BM25 rankings (each cut at top_k);
    score = max(0, sum 1/(rrf_k + rank)). Without a text index every query fails with
    ``knowledge_hybrid_unavailable``; a bad vector fails the request as in vector search."""
    requests = _requests(queries, grants, allowed_projects)
    if index is None:
        return _all_failed(requests, E.KNOWLEDGE_HYBRID_UNAVAILABLE, corpus, key_col)
    if any(c not in corpus.columns for c in REQUIRED + ("vector",)):
        return _all_failed(requests, E.KNOWLEDGE_UNAVAILABLE, corpus, key_col)
    requests = requests.withColumn("qvec", hash_embedding(F.col("query"), embed_dims))
    near, bad = _nearest(requests, corpus, key_col)
    same = ["_tg_rk", "top_k", key_col, "_tg_row", "_tg_copy"]
    copy = F.row_number().over(Window.partitionBy("_tg_rk", key_col, "_tg_row").orderBy("rank"))  # equal rows meet one to one
    near = near.withColumn("_tg_copy", copy).select(*same, F.col("rank").alias("rv"))
    text = _best_texts(requests, index).withColumn("_tg_copy", copy).select(*[F.col(c).alias(f"{c}_b") for c in same], F.col("rank").alias("rb"))
    meet = F.lit(True)
    for c in same:  # keys may be null
        meet = meet & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    fused = near.join(text, meet, "full_outer")
    fused = fused.select(*[F.when(F.col("rv").isNotNull(), F.col(c)).otherwise(F.col(f"{c}_b")).alias(c) for c in same], "rv", "rb")
    rrf = F.coalesce(1.0 / (rrf_k + F.col("rv")), F.lit(0.0)) + F.coalesce(1.0 / (rrf_k + F.col("rb")), F.lit(0.0))
    fused = fused.withColumn("score", F.greatest(rrf, F.lit(0.0)))
    return _finish(requests, _ranked(fused, [F.col("score").desc(), F.col(key_col), F.col("_tg_row"), F.col("_tg_copy")]), bad, corpus, key_col)

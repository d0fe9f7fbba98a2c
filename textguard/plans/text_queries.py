"""Queries for text helpers (P1, P2, B1), validation predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import text as X
from textguard.functions.hashing import uuid4_from_hex
from textguard.operators import validate as V
from textguard.operators.masking import anonymize
from textguard.plans import duck
from textguard.plans.registry import query
from textguard.sources.tables import read_table


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ESC_D = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("escape_untrusted", (
    f"SELECT page_id, CASE WHEN strlen(html) <= 102400 THEN {_ESC_D} END AS escaped, "
    "CASE WHEN strlen(html) > 102400 THEN 'validation_error' END AS error_code FROM pages"
))
def escape_untrusted(spark, sf_dir):
    """Raw web pages escaped as data (ampersand first); over 100 KiB is an error."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", X.escape_untrusted(F.col("html")).alias("escaped"),
                    X.escape_error(F.col("html"))["code"].alias("error_code"))


@query("render_prompts", (
    f"SELECT page_id, {_sql_str(X.SECURITY_HEAD)} || {_ESC_D} || {_sql_str(X.SECURITY_TAIL)} AS security_prompt, "
    f"{_sql_str(X.PRIVACY_HEAD)} || {_ESC_D} || {_sql_str(X.PRIVACY_TAIL)} AS privacy_prompt, "
    f"CAST((length({_sql_str(X.SECURITY_HEAD)} || {_ESC_D} || {_sql_str(X.SECURITY_TAIL)}) - "
    f"length(replace({_sql_str(X.SECURITY_HEAD)} || {_ESC_D} || {_sql_str(X.SECURITY_TAIL)}, '{X.ARCH_CLOSE}', ''))) "
    f"// {len(X.ARCH_CLOSE)} AS BIGINT) AS n_close FROM pages"
))
def render_prompts(spark, sf_dir):
    """Both audit prompts around each escaped page; exactly one closing delimiter survives."""
    p = read_table(spark, sf_dir, "pages")
    sec = X.security_audit_prompt(F.col("html"))
    n_close = ((F.char_length(sec) - F.char_length(F.replace(sec, F.lit(X.ARCH_CLOSE), F.lit("")))) / len(X.ARCH_CLOSE)).cast("long")
    return p.select("page_id", sec.alias("security_prompt"), X.privacy_audit_prompt(F.col("html")).alias("privacy_prompt"),
                    n_close.alias("n_close"))


BOUND = 4096


@query("bound_text", (
    f"SELECT page_id, CASE WHEN strlen(html) <= {BOUND} THEN html ELSE left(html, list_reduce(string_split(html, ''), "
    f"lambda acc, c: CASE WHEN acc.k = acc.n AND acc.b + strlen(c) <= {BOUND - len(X.TRUNCATION_MARKER.encode())} "
    "THEN {'b': acc.b + strlen(c), 'k': acc.k + 1, 'n': acc.n + 1} ELSE {'b': acc.b, 'k': acc.k, 'n': acc.n + 1} END, "
    "{'b': 0, 'k': 0, 'n': 0}).k) || chr(10) || '[output truncated]' END AS bounded FROM pages"
))
def bound_text(spark, sf_dir):
    """B1: page bytes bounded to 4 KiB including the marker, cut on a code-point boundary."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", X.bound_text(F.encode(F.col("html"), "UTF-8"), BOUND).alias("bounded"))


@query("validate_text_size", (
    "SELECT doc_id, CAST(strlen(repeat(text, 4)) AS BIGINT) AS n_bytes, "
    "CASE WHEN strlen(repeat(text, 4)) > 102400 THEN 'validation_error' END AS error_code FROM documents"
))
def validate_text_size(spark, sf_dir):
    """V1: the 100 KiB byte limit over each document repeated four times (some exceed it)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.repeat(F.col("text"), 4).alias("t"))
    return d.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"),
                    F.when(~V.text_ok(F.col("t")), F.lit("validation_error")).alias("error_code"))


_LANG_S = "CASE WHEN doc_id % 7 = 0 THEN 'pt' WHEN doc_id % 11 = 0 THEN upper(lang) ELSE lang END"


@query("validate_language", (
    f"SELECT doc_id, {_LANG_S} AS lang, {_LANG_S} IN ('de', 'en', 'fr', 'it', 'es') AS ok FROM documents"
))
def validate_language(spark, sf_dir):
    """V2: language enum (de, en, fr, it, es), case-sensitive."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.expr(_LANG_S).alias("lang"))
    return d.select("doc_id", "lang", V.language_ok(F.col("lang")).alias("ok"))


@query("validate_terms", (
    "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS terms FROM documents) "
    "SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, "
    "len(terms) <= 50 AND len(list_filter(terms, lambda x: strlen(x) < 1 OR strlen(x) > 100)) = 0 AS ok, "
    "CAST(len(list_distinct(terms)) AS BIGINT) AS n_distinct FROM t"
))
def validate_terms(spark, sf_dir):
    """V4: each document's lines as a term list: at most 50 terms of 1-100 UTF-8 bytes; order-kept dedupe."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.split(F.col("text"), "\n", -1).alias("terms"))
    return d.select("doc_id", F.size("terms").cast("long").alias("n_terms"), V.terms_ok(F.col("terms")).alias("ok"),
                    F.size(V.dedupe_terms(F.col("terms"))).cast("long").alias("n_distinct"))


_SID_D = ("substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || "
          "substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)")


@query("validate_session_id", (
    f"WITH b AS (SELECT event_id, {_SID_D} AS c FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events)), "
    "s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN c WHEN 1 THEN upper(c) "
    "WHEN 2 THEN substr(c, 1, 14) || '1' || substr(c, 16) WHEN 3 THEN substr(c, 1, 19) || 'c' || substr(c, 21) "
    "ELSE substr(c, 1, 35) END AS sid FROM b) "
    "SELECT event_id, sid, length(sid) = 36 AND sid = lower(sid) AND substr(sid, 15, 1) = '4' "
    "AND substr(sid, 20, 1) IN ('8', '9', 'a', 'b') "
    "AND regexp_full_match(sid, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS ok FROM s"
))
def validate_session_id(spark, sf_dir):
    """V5: canonical lower-case UUID version 4 (variant 8/9/a/b), 36 characters."""
    e = read_table(spark, sf_dir, "events").select("event_id")
    c = uuid4_from_hex(F.md5(F.col("event_id").cast("string")))
    k = F.col("event_id") % 5
    sid = (F.when(k == 0, c).when(k == 1, F.upper(c))
           .when(k == 2, F.concat(F.substring(c, 1, 14), F.lit("1"), F.substring(c, 16, 40)))
           .when(k == 3, F.concat(F.substring(c, 1, 19), F.lit("c"), F.substring(c, 21, 40)))
           .otherwise(F.substring(c, 1, 35)))
    return e.select("event_id", sid.alias("sid")).select("event_id", "sid", V.session_id_ok(F.col("sid")).alias("ok"))


_PID_S = ("CASE event_id % 4 WHEN 0 THEN concat(event_type, '_', user_id) WHEN 1 THEN concat(event_type, ' ', user_id) "
          "WHEN 2 THEN repeat('p', 129) ELSE concat('proj-', user_id, 'é') END")
_PID_D = ("CASE event_id % 4 WHEN 0 THEN event_type || '_' || user_id WHEN 1 THEN event_type || ' ' || user_id "
          "WHEN 2 THEN repeat('p', 129) ELSE 'proj-' || user_id || 'é' END")


@query("validate_project_id", (
    f"SELECT event_id, {_PID_D} AS project_id, regexp_full_match({_PID_D}, '[A-Za-z0-9_-]+') AND strlen({_PID_D}) <= 128 AS ok FROM events"
))
def validate_project_id(spark, sf_dir):
    """V6: project ids ``[A-Za-z0-9_-]+`` of at most 128 bytes."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.expr(_PID_S).alias("project_id"))
    return e.select("event_id", "project_id", V.project_id_ok(F.col("project_id")).alias("ok"))


@query("validate_topk", (
    "SELECT event_id, CAST(floor(value) AS INTEGER) - 40 AS top_k, CAST(floor(value) AS INTEGER) - 40 BETWEEN 1 AND 50 AS ok FROM events"
))
def validate_topk(spark, sf_dir):
    """V7: top_k must be an integer between 1 and 50."""
    e = read_table(spark, sf_dir, "events").select("event_id", (F.floor("value").cast("int") - 40).alias("top_k"))
    return e.select("event_id", "top_k", V.top_k_ok(F.col("top_k"), e.schema["top_k"].dataType).alias("ok"))


_ALLOWED = ("prompt", "language", "strategy", "on_secret", "whitelist", "blacklist")


@query("validate_unknown_fields", (
    "WITH j AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN to_json({'prompt': text, 'language': lang, 'mode_override': 1}) "
    "WHEN doc_id % 3 = 1 THEN to_json({'prompt': text, 'language': lang, 'strategy': 'redact'}) "
    "ELSE to_json({'prompt': text}) END AS req FROM documents) "
    "SELECT doc_id, len(list_filter(json_keys(req), lambda k: k NOT IN ('prompt', 'language', 'strategy', 'on_secret', 'whitelist', 'blacklist'))) = 0 AS ok, "
    "array_to_string(list_sort(list_filter(json_keys(req), lambda k: k NOT IN ('prompt', 'language', 'strategy', 'on_secret', 'whitelist', 'blacklist'))), ',') AS extra FROM j"
))
def validate_unknown_fields(spark, sf_dir):
    """V9: JSON requests built from documents; keys outside the anonymize fields are rejected."""
    d = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    req = (F.when(k == 0, F.to_json(F.struct(F.col("text").alias("prompt"), F.col("lang").alias("language"), F.lit(1).alias("mode_override"))))
           .when(k == 1, F.to_json(F.struct(F.col("text").alias("prompt"), F.col("lang").alias("language"), F.lit("redact").alias("strategy"))))
           .otherwise(F.to_json(F.struct(F.col("text").alias("prompt")))))
    j = d.select("doc_id", req.alias("req"))
    extra = V.unknown_fields(F.col("req"), _ALLOWED)
    return j.select("doc_id", V.fields_ok(F.col("req"), _ALLOWED).alias("ok"), F.array_join(F.array_sort(extra), ",").alias("extra"))


_ENV_T = ("concat(CASE WHEN doc_id % 4 = 0 THEN repeat(text, 4) ELSE text END, "
          "CASE WHEN doc_id % 5 = 0 THEN concat(' AKIA', lpad(cast(doc_id as string), 16, '0')) ELSE '' END)")
_ENV_T_D = ("CASE WHEN doc_id % 4 = 0 THEN repeat(text, 4) ELSE text END || "
            "CASE WHEN doc_id % 5 = 0 THEN ' AKIA' || lpad(doc_id::VARCHAR, 16, '0') ELSE '' END")


@query("error_envelope", (
    f"WITH s AS (SELECT doc_id, {_ENV_T_D} AS t, {_LANG_S} AS lang FROM documents) "
    "SELECT doc_id, CASE WHEN strlen(t) > 102400 OR lang NOT IN ('de', 'en', 'fr', 'it', 'es') THEN 'validation_error' "
    f"WHEN regexp_matches(t, '{duck.RE2['AWS_KEY'][0]}') THEN 'prohibited_secret_detected' END AS error_code, "
    "CASE WHEN strlen(t) > 102400 OR lang NOT IN ('de', 'en', 'fr', 'it', 'es') THEN 'invalid input' "
    f"WHEN regexp_matches(t, '{duck.RE2['AWS_KEY'][0]}') THEN 'prohibited secret detected' END AS error_message FROM s"
))
def error_envelope(spark, sf_dir):
    """Per-row error codes in the original precedence (validation before secret policy),
    with fixed messages that never contain input values."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.expr(_ENV_T).alias("text"), F.expr(_LANG_S).alias("lang"))
    a = anonymize(d, "text", lang_col="lang", on_secret="block", key_cols=["doc_id"])
    return a.masked.select("doc_id", F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"))


_OPT_S = ("CASE event_id % 5 WHEN 0 THEN 'placeholder' WHEN 1 THEN 'redact' WHEN 2 THEN 'hash' WHEN 3 THEN 'Hash' ELSE event_type END")
_SEC_S = "CASE WHEN event_id % 7 = 0 THEN 'warn' WHEN event_id % 2 = 0 THEN 'mask' ELSE 'block' END"


@query("validate_options", (
    f"SELECT event_id, {_OPT_S} AS strategy, {_SEC_S} AS on_secret, "
    f"{_OPT_S} IN ('placeholder', 'redact', 'hash') AND {_SEC_S} IN ('mask', 'block') AS ok FROM events"
))
def validate_options(spark, sf_dir):
    """V3 as a column check: strategy in placeholder/redact/hash and secret policy in mask/block."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.expr(_OPT_S).alias("strategy"), F.expr(_SEC_S).alias("on_secret"))
    return e.select("event_id", "strategy", "on_secret", V.options_ok(F.col("strategy"), F.col("on_secret")).alias("ok"))

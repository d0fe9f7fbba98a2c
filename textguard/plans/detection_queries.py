"""Queries for recognisers (R1-R17), checksums (C1, C2), the entity cap (D2) and overlap resolution (D3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions import sqltext as S
from textguard.operators.masking import detect
from textguard.plans import duck
from textguard.plans.registry import query
from textguard.plans.seeds import seeded_documents
from textguard.sources.tables import read_table

# query name -> (seed kind, recogniser)
RECOGNISER_QUERIES = {
    "detect_email": ("EMAIL_ADDRESS", P.EMAIL),
    "detect_iban": ("IBAN_CODE", P.IBAN),
    "detect_tax_id": ("GERMAN_TAX_ID", P.TAX_ID),
    "detect_phone_e164": ("PHONE_E164", P.PHONE_E164),
    "detect_phone_local": ("PHONE_LOCAL", P.PHONE_LOCAL),
    "detect_phone_formatted": ("PHONE_FORMATTED", P.PHONE_FORMATTED),
    "detect_plate": ("GERMAN_LICENSE_PLATE", P.PLATE),
    "detect_personal_id": ("PERSONAL_ID", P.PERSONAL_ID),
    "detect_person": ("PERSON", P.PERSON),
    "detect_aws_key": ("AWS_KEY", P.AWS_KEY),
    "detect_anthropic_key": ("ANTHROPIC_KEY", P.ANTHROPIC_KEY),
    "detect_openai_key": ("OPENAI_KEY", P.OPENAI_KEY),
    "detect_github_token": ("GITHUB_TOKEN", P.GITHUB_TOKEN),
    "detect_private_key": ("PRIVATE_KEY", P.PRIVATE_KEY),
    "detect_jwt": ("JWT_TOKEN", P.JWT_TOKEN),
    "detect_connection_string": ("CONNECTION_STRING", P.CONNECTION_STRING),
}

CUSTOM = {"ORDER_NO": r"ORD-[0-9]{6}"}


def _hits(df):
    return df.select(
        "doc_id",
        F.size("entities").cast("long").alias("n_hits"),
        F.array_join(F.transform("entities", lambda s: s["value"]), "|").alias("hits"),
    )


def _detect_oracle(kind: str) -> str:
    return (
        f"WITH s AS (SELECT doc_id, {duck.seeded(kind)} AS t FROM documents), "
        f"m AS (SELECT doc_id, {duck.extract(kind, 't')} AS m FROM s) "
        f"SELECT doc_id, CAST(len(m) AS BIGINT) AS n_hits, array_to_string(m, '|') AS hits FROM m"
    )


def _make_detect(kind, rec):
    def run(spark, sf_dir):
        """Raw matches of one recogniser (after its own check) over every seeded document."""
        docs = seeded_documents(read_table(spark, sf_dir, "documents"), kind)
        return _hits(detect(docs, "text", recognizers=[rec], resolve=False))
    return run


for _name, (_kind, _rec) in RECOGNISER_QUERIES.items():
    query(_name, _detect_oracle(_kind))(_make_detect(_kind, _rec))


@query("detect_custom", _detect_oracle("ORDER_NO"))
def detect_custom(spark, sf_dir):
    """A caller pattern, run through the same span finder as the built-in rules."""
    docs = seeded_documents(read_table(spark, sf_dir, "documents"), "ORDER_NO")
    return _hits(detect(docs, "text", recognizers=[], custom_patterns=CUSTOM, resolve=False))


_IBAN3 = "concat('DE', lpad(cast(doc_id % 97 as string), 2, '0'), lpad(cast(doc_id * 7919 as string), 18, '0'))"
_IBAN3_D = "'DE' || lpad((doc_id % 97)::VARCHAR, 2, '0') || lpad((doc_id * 7919)::VARCHAR, 18, '0')"


@query("iban_checksum", (
    f"WITH c AS (SELECT doc_id, 1 AS kind, {duck.IBAN_PICK} AS candidate FROM documents "
    f"UNION ALL SELECT doc_id, 2, {duck.SEEDS['IBAN_CODE'][1]} FROM documents "
    f"UNION ALL SELECT doc_id, 3, {_IBAN3_D} FROM documents) "
    f"SELECT doc_id, CAST(kind AS BIGINT) AS kind, candidate, {duck.valid_iban('candidate')} AS valid FROM c"
))
def iban_checksum(spark, sf_dir):
    """C1 over three candidates per document: a sample IBAN, its 00 twin, a derived DE number."""
    from textguard.plans.seeds import CANDIDATES, SAMPLE_IBANS, _arr
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    pick = f"element_at({_arr(SAMPLE_IBANS)}, cast(doc_id % 8 + 1 as int))"
    cands = F.array(
        F.struct(F.lit(1).cast("long").alias("kind"), F.expr(pick).alias("candidate")),
        F.struct(F.lit(2).cast("long").alias("kind"), F.expr(CANDIDATES["IBAN_CODE"][1]).alias("candidate")),
        F.struct(F.lit(3).cast("long").alias("kind"), F.expr(_IBAN3).alias("candidate")),
    )
    out = docs.select("doc_id", F.inline(cands))
    return out.select("doc_id", "kind", "candidate", F.expr(S.valid_iban(S.normalized("candidate"))).alias("valid"))


@query("tax_id_checksum", (
    "WITH c AS (SELECT doc_id, 1 AS kind, '1' || lpad(doc_id::VARCHAR, 9, '0') || (doc_id % 10)::VARCHAR AS candidate FROM documents "
    "UNION ALL SELECT doc_id, 2, '2' || lpad(doc_id::VARCHAR, 9, '0') || ((doc_id * 3) % 10)::VARCHAR FROM documents "
    "UNION ALL SELECT doc_id, 3, repeat((doc_id % 10)::VARCHAR, 11) FROM documents) "
    f"SELECT doc_id, CAST(kind AS BIGINT) AS kind, candidate, {duck.valid_tax_id('candidate')} AS valid FROM c"
))
def tax_id_checksum(spark, sf_dir):
    """C2 over three candidates per document (one of them eleven equal digits)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    cands = F.array(
        F.struct(F.lit(1).cast("long").alias("kind"), F.expr("concat('1', lpad(cast(doc_id as string), 9, '0'), cast(doc_id % 10 as string))").alias("candidate")),
        F.struct(F.lit(2).cast("long").alias("kind"), F.expr("concat('2', lpad(cast(doc_id as string), 9, '0'), cast((doc_id * 3) % 10 as string))").alias("candidate")),
        F.struct(F.lit(3).cast("long").alias("kind"), F.expr("repeat(cast(doc_id % 10 as string), 11)").alias("candidate")),
    )
    out = docs.select("doc_id", F.inline(cands))
    return out.select("doc_id", "kind", "candidate", F.expr(S.valid_tax_id("candidate")).alias("valid"))


@query("entity_cap", (
    "WITH s AS (SELECT doc_id, text || repeat(' x' || doc_id || '@example.com', CAST(999 + doc_id % 3 AS INTEGER)) AS t FROM documents), "
    f"m AS (SELECT doc_id, {duck.extract('EMAIL_ADDRESS', 't')} AS m FROM s) "
    "SELECT doc_id, CASE WHEN len(m) > 1000 THEN 'validation_error' END AS error_code, "
    "CASE WHEN len(m) > 1000 THEN NULL ELSE CAST(len(m) AS BIGINT) END AS n_entities FROM m"
))
def entity_cap(spark, sf_dir):
    """More than 1,000 raw hits in one text is a validation error (999, 1,000, 1,001 seeded)."""
    docs = read_table(spark, sf_dir, "documents")
    seeded = docs.select("doc_id", F.concat(F.col("text"), F.expr("repeat(concat(' x', doc_id, '@example.com'), cast(999 + doc_id % 3 as int))")).alias("text"))
    d = detect(seeded, "text", recognizers=[P.EMAIL])
    return d.select("doc_id", F.col("entities_error.code").alias("error_code"),
                    F.size("entities").cast("long").alias("n_entities"))


# D3: several overlapping candidates per document: a connection string that contains an
# e-mail, an OpenAI key inside an Anthropic key, a formatted phone that contains an E.164 prefix.
_OVERLAP_SEED = (
    "concat(text, ' postgres://u', doc_id, ':p@example.com/db ', 'sk-ant-', lpad(cast(doc_id as string), 20, 'b'), "
    "' +33 1 42 ', lpad(cast(doc_id as string), 8, '0'), ' x', doc_id, '@example.com ')"
)
_OVERLAP_SEED_D = (
    "text || ' postgres://u' || doc_id || ':p@example.com/db ' || 'sk-ant-' || lpad(doc_id::VARCHAR, 20, 'b') || "
    "' +33 1 42 ' || lpad(doc_id::VARCHAR, 8, '0') || ' x' || doc_id || '@example.com '"
)
_OVERLAP_KINDS = ["EMAIL_ADDRESS", "PHONE_E164", "GERMAN_LICENSE_PLATE", "ANTHROPIC_KEY", "OPENAI_KEY", "CONNECTION_STRING", "PHONE_FORMATTED"]


def _hits_of(ord_: int, kind: str) -> str:
    """Whole matches (phones with the sign before and after them) and the pieces between them, in DuckDB."""
    pattern, group = duck.RE2[kind]
    etype = "PHONE_NUMBER" if group else kind
    return (f"SELECT doc_id, '{etype}' AS etype, {ord_} AS ord, {group} AS grouped, regexp_extract_all(t, '{pattern}') AS m, "
            f"regexp_extract_all(t, '{pattern}', {group}) AS v, regexp_split_to_array(t, '{pattern}') AS g FROM t")


@query("resolve_overlaps", (
    f"WITH RECURSIVE t AS (SELECT doc_id, {_OVERLAP_SEED_D} AS t FROM documents), "
    f"h AS ({' UNION ALL '.join(_hits_of(i, k) for i, k in enumerate(_OVERLAP_KINDS))}), "
    "s AS (SELECT doc_id, etype, ord, v[i] AS value, length(array_to_string(list_slice(g, 1, i), '') || array_to_string(list_slice(m, 1, i - 1), '')) "
    "  + CASE WHEN grouped = 1 AND m[i][1] <> '+' THEN 1 ELSE 0 END AS st FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM h)), "
    "r AS (SELECT *, st + length(value) AS en, row_number() OVER (PARTITION BY doc_id ORDER BY length(value) DESC, st, ord) AS rn FROM s "
    f"  WHERE ord <> {len(_OVERLAP_KINDS) - 1} OR {duck.phone_digits_ok('value')}), "
    # greedy over the ranked spans: one that meets none of those kept so far is kept
    "k AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(st BIGINT, en BIGINT, etype VARCHAR, value VARCHAR)[]) AS kept FROM documents "
    "  UNION ALL SELECT k.doc_id, r.rn, CASE WHEN len(list_filter(k.kept, lambda x: x.st < r.en AND r.st < x.en)) > 0 THEN k.kept "
    "  ELSE list_append(k.kept, {'st': r.st, 'en': r.en, 'etype': r.etype, 'value': r.value}) END FROM k JOIN r ON r.doc_id = k.doc_id AND r.rn = k.rn + 1), "
    "o AS (SELECT doc_id, list_sort(arg_max(kept, rn)) AS kept FROM k GROUP BY doc_id) "
    "SELECT doc_id, CAST(len(kept) AS BIGINT) AS n_kept, array_to_string(list_transform(kept, lambda x: x.etype || ':' || x.st || ':' || x.value), '|') AS kept FROM o"
))
def resolve_overlaps(spark, sf_dir):
    """D3 over seeded overlapping candidates: longest, then leftmost, then detection order wins."""
    docs = read_table(spark, sf_dir, "documents")
    seeded = docs.select("doc_id", F.expr(_OVERLAP_SEED).alias("text"))
    recs = [P.EMAIL, P.PHONE_E164, P.PLATE, P.ANTHROPIC_KEY, P.OPENAI_KEY, P.CONNECTION_STRING, P.PHONE_FORMATTED]
    d = detect(seeded, "text", recognizers=recs)
    return d.select(
        "doc_id",
        F.size("entities").cast("long").alias("n_kept"),
        F.array_join(F.transform("entities", lambda s: F.concat(s["etype"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["value"])), "|").alias("kept"),
    )


# A stand-in for an external analyzer's output in the expected schema: one span per
# document over its first word, with a score derived from doc_id (half of them below 0.5).
_EXT_END = "char_length(regexp_extract(text, '^[^ \\\\n]+', 0))"
_EXT_END_D = "length(regexp_extract(text, '^[^ \\n]+', 0))"


@query("detect_external_spans", (
    f"WITH x AS ({duck.masked_lists('text', ['EMAIL_ADDRESS', 'GERMAN_LICENSE_PLATE'], 'documents')}), "
    f"y AS (SELECT *, {_EXT_END_D} AS el, (doc_id % 10) >= 5 AND {_EXT_END_D} > 0 AS ext_ok, "
    "  list_transform(range(1, len(m) + 1), lambda i: length(array_to_string(list_slice(g, 1, i), '')) "
    "    + length(array_to_string(list_slice(m, 1, i - 1), ''))) AS st FROM x), "
    # greedy: the external span (listed first) loses only to a strictly longer overlapping span
    "z AS (SELECT *, ext_ok AND NOT coalesce(list_bool_or(list_transform(range(1, len(m) + 1), "
    "  lambda i: st[i] < el AND length(m[i]) > el)), false) AS keep_ext FROM y), "
    "k AS (SELECT *, list_filter(range(1, len(m) + 1), lambda i: NOT keep_ext OR st[i] >= el) AS kept FROM z) "
    "SELECT doc_id, CAST(len(kept) + CASE WHEN keep_ext THEN 1 ELSE 0 END AS BIGINT) AS n_entities, "
    "array_to_string(CASE WHEN keep_ext THEN ['ORG:' || substr(text, 1, el)] ELSE [] END "
    "|| list_transform(kept, lambda i: ty[i] || ':' || m[i]), '|') AS entities FROM k"
))
def detect_external_spans(spark, sf_dir):
    """External spans (score >= 0.5 kept) merged with the regex spans and re-resolved."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ext = docs.select("doc_id", F.lit("ORG").alias("etype"), F.lit(0).alias("start"), F.expr(_EXT_END).alias("end"),
                      ((F.col("doc_id") % 10) / 10.0).alias("score")).filter(F.col("end") > 0)
    d = detect(docs, "text", external_spans=ext, key_cols=["doc_id"])
    return d.select("doc_id", F.size("entities").cast("long").alias("n_entities"),
                    F.array_join(F.transform("entities", lambda s: F.concat(s["etype"], F.lit(":"), s["value"])), "|").alias("entities"))

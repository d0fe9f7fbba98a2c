"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_conversations, loss_text, parse_formatted
from .common import fold_of, table
from .decontaminate import contained_items
from .divergence import source_divergence
from .grouped_packing import WordEncoder, pack_whole
from .packing import Encoder, pack
from .quality_rules import fit_quality
from .recurrent_lm import score_documents
from .repair import damage, repair_conversations
from .resample import resample
from .setsketch import near_duplicates
from .sharding import shard_rows
from .toxicity import fit_toxicity
from .url_reputation import Rule, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed values of the task: the url rules, the extra conversation.
URL_RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]
EXTRA_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
#: Shards are small enough to be read whole by one loader worker.
SHARD_BYTES = 1 << 20


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


@query("op2_decontaminate", """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ish AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s, least(5, len(w)) AS width
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
q AS (SELECT item_id, count(*) AS q FROM ish GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM ish),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + width - 1], ' ') AS s
        FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM dw, widths WHERE len(w) >= width))
SELECT doc_id, item_id, CAST(any_value(q) AS INTEGER) AS n_item, count(*) AS n_shared
FROM dsh JOIN ish USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(q)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair in which the document contains 80 % of the item's shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_shards", f"""
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS bytes, lpad(bin(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
lv AS (SELECT doc_id, bytes, k, substr(bits, 1, k) AS p FROM d, (SELECT unnest(range(0, 41)) AS k)),
b AS (SELECT p, sum(bytes) AS shard_bytes, count(*) AS shard_rows FROM lv GROUP BY p HAVING sum(bytes) <= {SHARD_BYTES} OR count(*) = 1)
SELECT doc_id, CAST(arg_min(bytes, k) AS BIGINT) AS bytes, arg_min(p, k) AS shard, CAST(min(k) AS INTEGER) AS depth, CAST(arg_min(shard_bytes, k) AS BIGINT) AS shard_bytes, arg_min(shard_rows, k) AS shard_rows
FROM lv JOIN b USING (p) GROUP BY doc_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into shards of at most ``SHARD_BYTES`` text bytes."""
    return shard_rows(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)


@query("op4_chat", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior FROM t),
b AS (SELECT conv_id, CAST(min(place) FILTER (prior || '>' || role NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS INTEGER) AS bad_turn, arg_max(role, place) AS ends FROM o GROUP BY conv_id)
SELECT conv_id, any_value(bad_turn IS NULL AND ends = 'assistant') AS valid, any_value(bad_turn) AS bad_turn, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('### ' || replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\\'), '<', '\l'), '#', '\h') || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t JOIN b USING (conv_id) GROUP BY conv_id
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted text and its segments, and the role machine's verdict."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string"))
    out = format_conversations(rows)
    turns = parse_formatted(F.col("formatted"))
    loss = loss_text(F.col("segments"))
    read = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", "valid", "bad_turn", F.size(turns).cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op10_url_filter", r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(x), 0) AS DOUBLE) AS x FROM p LEFT JOIN o USING (page_id) GROUP BY host),
g0 AS (SELECT (sum(x) + 1) / (sum(n) + 2) AS m FROM h),
a1 AS (SELECT suffix, sum(n) AS n, sum(x) AS x, any_value(m) AS m FROM h, g0 GROUP BY suffix),
r1 AS (SELECT sum((x - n * m) ** 2) AS s, sum(n * m * (1 - m)) AS a, sum(n * (n - 1) * m * (1 - m)) AS b FROM a1 WHERE n > 0),
s1 AS (SELECT CASE WHEN coalesce(b, 0) = 0 THEN 1000.0 ELSE 1 / least(greatest((s - a) / b, 1 / 1001.0), 1 / 3.0) - 1 END AS s FROM r1),
m1 AS (SELECT suffix, (x + s * m) / (n + s) AS m FROM a1, s1),
a2 AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x, any_value(m) AS m FROM h JOIN m1 USING (suffix) GROUP BY suffix, domain),
r2 AS (SELECT sum((x - n * m) ** 2) AS s, sum(n * m * (1 - m)) AS a, sum(n * (n - 1) * m * (1 - m)) AS b FROM a2 WHERE n > 0),
s2 AS (SELECT CASE WHEN coalesce(b, 0) = 0 THEN 1000.0 ELSE 1 / least(greatest((s - a) / b, 1 / 1001.0), 1 / 3.0) - 1 END AS s FROM r2),
m2 AS (SELECT suffix, domain, (x + s * m) / (n + s) AS m FROM a2, s2),
a3 AS (SELECT host, n, x, m FROM h JOIN m2 USING (suffix, domain)),
r3 AS (SELECT sum((x - n * m) ** 2) AS s, sum(n * m * (1 - m)) AS a, sum(n * (n - 1) * m * (1 - m)) AS b FROM a3 WHERE n > 0),
s3 AS (SELECT CASE WHEN coalesce(b, 0) = 0 THEN 1000.0 ELSE 1 / least(greatest((s - a) / b, 1 / 1001.0), 1 / 3.0) - 1 END AS s FROM r3),
ab AS (SELECT host, x + s * m AS al, n - x + s * (1 - m) AS be FROM a3, s3),
bd AS (SELECT host, al / (al + be) - 1.645 * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) AS bound FROM ab),
rules(rule, rhost, rpath, rverdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fit AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path FROM p), rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN bd.bound > g0.m THEN 'block' ELSE 'allow' END) AS verdict
FROM p CROSS JOIN g0 LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path LEFT JOIN bd ON p.host = bd.host
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url. A page's outcome is its label: bad if it is of low quality or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page"), F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_importance")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance weight and Gumbel top-k draw of every document."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rules and the likelihood-ratio verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels)
    s = F.col("s")
    return docs.select("doc_id", model.columns(F.col("text")).alias("s")).select(
        "doc_id", *[f"s.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        model.base_failed(s).alias("base_failed"), model.kept(s).alias("kept"), "s.ratio")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learnt from the rows outside the held-out fold only."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    scored = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_near_duplicates", """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(4, len(w)) - 1], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are at least 80 % alike."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def public_encoder() -> Encoder:
    """The encoder of ``byte_bpe_50k``; its vocabulary file as ranks stands beside the json file on every machine."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document packed into sequences of at most 1,024 tokens."""
    pieces = pack(table(spark, sf_dir, "documents"), public_encoder())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_language_model")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and recurrent-model log10 probability of every whole document."""
    return score_documents(table(spark, sf_dir, "documents"))


@query("op11_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(s.n, 0)::HUGEINT AS n, coalesce(v.v, 0)::HUGEINT AS v, coalesce(v.total, 0)::HUGEINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.n + 5 * g.v) AS BIGINT) AS p,
             CAST(1 + (1000000000 * (k.total + 5)::HUGEINT) // (g.total + 5 * g.v) AS BIGINT) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that each source has most above its language."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: ascii(s)::BIGINT)),
                             lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) % 20 AS k FROM conversations, crc),
y AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM x, (SELECT unnest([1, 2]) AS copy) WHERE k <> 0 AND (copy = 1 OR k = 3)),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM y),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM w),
r AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
             CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM z),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
ins(state, goal, cost, audit, turns) AS (VALUES ('', '', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []), ('', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']),
      ('u', 'a', 3, 'I', ['assistant:']), ('', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, goal AS state, {'cost': cost, 'audit': audit, 'turns': turns} AS best FROM f, ins WHERE state = ''
  UNION ALL
  SELECT conv_id, i, goal, min({'cost': best.cost + cost, 'audit': best.audit || audit, 'turns': list_concat(best.turns, turns)}) FROM (
    SELECT e.conv_id, e.i, ins.goal, e.best, ins.cost, ins.audit, ins.turns FROM (
      SELECT dp.conv_id, r.i, m.goal, {'cost': dp.best.cost + m.cost + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END, 'audit': dp.best.audit || m.edit,
             'turns': CASE m.edit WHEN 'D' THEN dp.best.turns WHEN 'K' THEN list_append(dp.best.turns, r.role || ':' || r.text) ELSE list_append(dp.best.turns, CASE m.goal WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text) END} AS best
      FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
      JOIN (VALUES ('', 's', 'K', 0, 's'), ('', 'u', 'K', 0, 'u'), ('s', 'u', 'K', 0, 'u'), ('u', 'a', 'K', 0, 'a'), ('a', 'u', 'K', 0, 'u'), ('', 'u', 'R', 3, ''), ('s', 'u', 'R', 3, ''), ('u', 'a', 'R', 3, ''), ('a', 'u', 'R', 3, ''),
                   ('', '', 'D', 4, ''), ('s', 's', 'D', 4, ''), ('u', 'u', 'D', 4, ''), ('a', 'a', 'D', 4, '')) m(state, goal, edit, cost, initial)
        ON m.state = dp.state AND (m.edit <> 'K' OR m.initial = r.initial) AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    ) e JOIN ins ON ins.state = e.goal
  ) GROUP BY conv_id, i, goal),
o AS (SELECT dp.conv_id, min(best) AS best FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = f.n WHERE state IN ('', 'a') GROUP BY dp.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(o.best.cost, 0) AS BIGINT) AS cost, coalesce(o.best.audit, '') AS audit, sha256(coalesce(array_to_string(o.best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the audit of its cheapest repair and the repaired turns' digest."""
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


@query("op13_best_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in as few sequences of at most 2,048 tokens as linear grouping finds."""
    import public_tokenizers

    pieces = pack_whole(table(spark, sf_dir, "documents"), WordEncoder(public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

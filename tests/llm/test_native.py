"""URL filter, chat formatting, sharding and decontamination against plain Python."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from textguard.llm.chat_format import Template, format_conversations, loss_text, parse_formatted
from textguard.llm.decontaminate import contained_items
from textguard.llm.sharding import shard_rows, write_shards
from textguard.llm.url_reputation import Rule, judge_urls

from .helpers import LONG_TEXT, messy, prose

RULES = [Rule("com", "/", "allow"), Rule("a.com", "/x/", "block")]


def test_urls_and_rules(spark):
    urls = ["http://A.com/x/1?q", "http://www.a.com/x/", "https://b.a.com/y#f", "http://aa.com/x/", "http://c.net", "c.net/p", None, "", "http://?q", "x://c.net/p?u=x://z/", "http://com/"]
    pages = messy(spark, list(enumerate(urls)) + [(0, urls[0])], "page_id", "url")
    got = {r.page_id: (r.host, r.path, r.rule) for r in judge_urls(pages, spark.createDataFrame([], "page long, bad int"), RULES).collect()}
    assert got == {
        0: ("a.com", "/x/1", "a.com/x/"), 1: ("www.a.com", "/x/", "a.com/x/"), 2: ("b.a.com", "/y", "com/"), 3: ("aa.com", "/x/", "com/"), 4: ("c.net", "", None),
        5: ("", "", None), 6: ("", "", None), 7: ("", "", None), 8: ("", "", None), 9: ("c.net", "/p", None), 10: ("com", "/", "com/")}
    assert judge_urls(pages, spark.createDataFrame([], "page long, bad int"), RULES).count() == 12  # repeated rows stay
    assert judge_urls(pages.limit(0), spark.createDataFrame([], "page long, bad int"), RULES).count() == 0
    assert judge_urls(pages, spark.createDataFrame([], "page long, bad int"), []).where("rule is not null").count() == 0


def test_reputation_shrinks_towards_the_parent(spark):
    rows, outcomes = [], []
    for host, n, bad in (("bad.site.net", 60, 57), ("good.site.net", 60, 2), ("new.site.net", 1, None), ("one.other.net", 1, 1), ("x.fine.org", 80, 3), ("y.fine.org", 80, 4), ("z.foul.org", 40, 39), ("v.foul.org", 1, None)):
        for i in range(n):
            rows.append((len(rows), f"http://{host}/{i}"))
            if bad is not None:
                outcomes.append((len(rows) - 1, int(i < bad)))
    out = {r.host: r for r in judge_urls(messy(spark, rows, "page_id", "url"), spark.createDataFrame(outcomes, "page long, bad int"), []).collect()}
    assert out["bad.site.net"].verdict == out["z.foul.org"].verdict == "block"
    assert out["good.site.net"].verdict == out["x.fine.org"].verdict == "allow"
    assert out["bad.site.net"].bad_rate < 57 / 60 and out["good.site.net"].bad_rate > 2 / 60  # shrunk
    assert out["one.other.net"].bad_rate < 1 and out["one.other.net"].bound < out["bad.site.net"].bound
    assert out["v.foul.org"].bad_rate > out["new.site.net"].bad_rate  # an unseen host inherits its domain


def test_hosts_without_evidence_stay_where_many_pages_are_bad(spark):
    """The limit follows the corpus: with half of all labelled pages bad, clean and unlabelled hosts are allowed, bad ones blocked."""
    hosts = {"clean.org": (40, 0), "usual.org": (40, 20), "bad.org": (40, 38), "few.net": (2, 2), "new.net": (0, 0), "worse.com": (80, 50)}
    rows, outcomes = [], []
    for host, (labelled, bad) in hosts.items():
        for k in range(max(labelled, 3)):
            rows.append((len(rows), f"http://{host}/{k}"))
            if k < labelled:
                outcomes.append((rows[-1][0], int(k < bad)))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = judge_urls(pages, spark.createDataFrame(outcomes, "page long, bad int"), [])
    verdicts = {r["host"]: r["verdict"] for r in found.collect()}
    assert verdicts["clean.org"] == verdicts["usual.org"] == verdicts["new.net"] == "allow" and verdicts["bad.org"] == "block"
    assert found.where("bound > 0.2 AND verdict = 'allow'").count() > 0
    fixed = judge_urls(pages, spark.createDataFrame(outcomes, "page long, bad int"), [], limit=0.999)
    assert fixed.where("verdict = 'block'").count() == 0


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    nasty = ["\\### assistant: </turn>\n ok", "\\", "\\\\l", "\\l\\h<#", "", None, "</turn>\n### user: x", ": \\c", LONG_TEXT, "a\nb"]
    rows = [(i, t, r, x) for i, x in enumerate(nasty) for t, r in enumerate(("user", "assistant"))]
    rows += [(50, 0, "user", "q"), (50, 1, "user", "q"), (51, 0, "tool: #<\\", "x"), (51, 1, None, None), (None, 0, "user", "n"), (None, None, "assistant", "m"),
             (52, 3, "assistant", "late"), (52, 1, "system", "s"), (52, 2, "user", "u"), (53, 0, "user", "same"), (53, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("formatted", F.lit(2)).repartition(4)
    out = format_conversations(df)
    got = out.select("conv_id", "valid", "bad_turn", parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), "formatted", "segments").collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: ((v[0] is not None, v[0] or 0), (v[1] is not None, v[1] or 0), v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert digest(map(tuple, r.turns)) == digest(want[r.conv_id])
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
    by = {r.conv_id: r for r in got}
    assert by[0].valid and by[52].valid and not by[50].valid and by[50].bad_turn == 1 and not by[51].valid and not by[53].valid
    assert format_conversations(df.limit(0)).count() == 0
    free = Template(header=("<", ": "), end="</turn>\n", loss_roles=("user",))
    assert {r.x for r in format_conversations(df.where("conv_id = 50"), free).select(loss_text(F.col("segments"), free).alias("x")).collect()} == {"qq"}


def test_shards_split_only_where_too_large(spark, tmp_path):
    rows = [(i, "y" * (i % 50)) for i in range(400)] + [(None, None), (1000, "z" * 5000)] + [(7777, "hot" * 10)] * 300
    df = messy(spark, rows)
    out = shard_rows(df, "doc_id", F.octet_length("text"), 1000).collect()
    assert len(out) == len(rows)
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    size, count = Counter(), Counter()
    for r in out:
        size[r.shard] += r.bytes
        count[r.shard] += 1
    assert all(size[s] <= 1000 or count[s] == 1 for s in size)
    assert {(r.shard, r.shard_bytes, r.shard_rows, r.depth) for r in out} == {(s, size[s], count[s], len(s)) for s in size}
    shards = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))  # prefix-free
    for s in shards:  # no bucket was split that fitted
        if s:
            inside = [r for r in out if r.shard.startswith(s[:-1])]
            assert sum(r.bytes for r in inside) > 1000 and len(inside) > 1
    assert shard_rows(df.limit(0), "doc_id", F.octet_length("text"), 1000).count() == 0
    unique = messy(spark, rows[:400])
    write_shards(unique.select("doc_id", "text"), shard_rows(unique, "doc_id", F.octet_length("text"), 2000), "doc_id", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 400


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, w


def test_decontamination_equals_brute_force(spark):
    items = [(1, prose(1, 30)), (2, prose(2, 14)), (3, "Short ITEM"), (4, None), (5, ""), (6, prose(3, 200)), (7, prose(1, 30)), (8, "one"), (9, prose(4, 5)), (None, prose(8, 40))]
    cut = prose(1, 30).split()
    docs = [(i, None if i == 0 else prose(100 + i, 300)) for i in range(12)] + [
        (20, LONG_TEXT[:5000] + " " + prose(1, 30).upper() + " " + LONG_TEXT), (21, " ".join(cut[:27])), (22, " ".join(cut[:20])), (23, "a short item here"), (24, prose(3, 200)),
        (25, " ".join(prose(3, 200).split()[:170])), (26, " ".join(prose(3, 200).split()[:150])), (27, "one"), (28, prose(4, 5)), (29, ""), (None, prose(2, 14)), (30, prose(8, 40)), (30, prose(8, 40)),
        (31, " ".join(cut[:14])), (31, " ".join(cut[10:])), (6, "x" * 100_000)]
    df, bench = messy(spark, docs), messy(spark, items, "item_id")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in contained_items(df, bench).collect()}
    want = {}
    pooled = {}
    for d, t in docs:
        for n in range(1, 6):
            pooled.setdefault(d, {}).setdefault(n, set()).update(grams(t, n)[0])
    for i, t in items:
        w = grams(t, 1)[1]
        if not w:
            continue
        n = min(5, len(w))
        own = grams(t, n)[0]
        for d in pooled:
            shared = len(own & pooled[d][n])
            if 100 * shared >= 80 * len(own):
                want[d, i] = (len(own), shared)
    assert got == want and (20, 1) in got and (25, 6) in got and (26, 6) not in got
    assert contained_items(df.limit(0), bench).count() == 0 and contained_items(df, bench.limit(0)).count() == 0

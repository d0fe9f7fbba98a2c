"""Conversation repair: audits against an exhaustive search, collisions, written-off prefixes, messy rows."""

import functools
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from textguard.llm import repair as R
from textguard.llm.queries import ORACLES, QUERIES
from textguard.llm.repair import damage, precedes, repair_conversations, repaired_turns

COLUMNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, turns) by trying every edit sequence; rows are (role, text, delete, truncated)."""
    @functools.lru_cache(None)
    def best(i, q, inserted):
        to, role = (R.ASSISTANT, "assistant") if q == R.USER else (R.USER, "user")
        found = [(0, "", ())] if i == len(rows) and q in (R.START, R.ASSISTANT) else []
        if inserted < 2:
            c, a, t = best(i, to, inserted + 1)
            found.append((c + 3, "I" + a, ((role, ""), *t)))
        if i < len(rows):
            own, text, delete, truncated = rows[i]
            c, a, t = best(i + 1, q, 0)
            found.append((c + 4, "D" + a, t))
            if not delete:
                if (q, own[:1]) in R.MOVES:
                    c, a, t = best(i + 1, R.MOVES[q, own[:1]], 0)
                    found.append((c + 3 * truncated, "K" + a, ((own, text), *t)))
                c, a, t = best(i + 1, to, 0)
                found.append((c + 3 * truncated + 3, "R" + a, ((role, text), *t)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    return best(0, R.START, 0)


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


@pytest.mark.parametrize("modulus, live", [(R.MODULUS, 4096), (7, 4096), (R.MODULUS, 3), (7, 2)])
def test_audit_is_the_least_of_the_cheapest(monkeypatch, modulus, live):
    """Also with hashes that collide all the time, and with prefixes written off after a few letters."""
    monkeypatch.setattr(R, "MODULUS", modulus)
    monkeypatch.setattr(R, "LIVE_LETTERS", live)
    rng = random.Random(modulus + live)
    for _ in range(500):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", " "]), rng.choice("abc"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 11))]
        state = R.Repair()
        for row in rows:
            state.add(*row)
        cost, audit, turns = cheapest(rows)
        assert state.result() == (cost, audit, digest(turns))


def test_comparison_of_linked_edits(monkeypatch):
    for modulus in (R.MODULUS, 3):
        monkeypatch.setattr(R, "MODULUS", modulus)
        rng = random.Random(4)
        nodes = [(R.Edits(), "")]
        for _ in range(300):
            node, letters = rng.choice(nodes[-40:])
            letter = rng.choice("DIKR")
            nodes.append((R.Edits(node, letter), letters + letter))
        for _ in range(3000):
            (a, x), (b, y) = rng.choice(nodes), rng.choice(nodes)
            assert precedes(a, b) == (x < y)


def test_a_long_conversation_keeps_few_edits_alive():
    rng, state = random.Random(1), R.Repair()
    for _ in range(20_000):
        state.add(rng.choice(["user", "assistant", "tool"]), "hello", rng.random() < 0.1, rng.random() < 0.1)
    assert max(s[1].length for s in state.states if s) < 3 * R.LIVE_LETTERS
    cost, audit, _ = state.result()
    assert cost > 0 and sum(c != "I" for c in audit) == 20_000


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "user", "cut off"), (1, 7, "tool", "x!"),
    (2, None, None, None), (2, 3, "system", "S."), (2, 3, "system", "S."), (2, 9, "system", "\t\n "),
    (None, 0, "user", "Lost."), (None, 1, "user", "Lost."), (3, 0, "assistant", "A" * 200_000 + "? \n"), (4, None, "", ""), (5, -2, "user", "u "),
    *[(6, k, random.Random(k).choice(["user", "assistant", "system"]), f"{k % 13}{random.Random(k).choice(['.', ''])}") for k in range(300)],
]


def expected(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            body = text.rstrip(R.BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, *_ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in R.LEGAL for a, b in zip(own, own[1:]))
        cost, audit, repaired = cheapest(tuple(marked))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, digest(repaired)), repaired
    return out


def test_rows_against_exhaustive_search(spark):
    rows = spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], COLUMNS + ", conv int, number int, fault int").repartition(3)
    repaired = repair_conversations(rows)
    want = expected(ROWS)
    assert {r["conv_id"]: tuple(r)[1:] for r in repaired.collect()} == {c: w for c, (w, _) in want.items()}
    turns = {}
    for r in sorted(repaired_turns(rows, repaired).collect(), key=lambda r: r["position"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {c: tuple(t) for c, t in turns.items()} == {c: t for c, (_, t) in want.items() if t}


def test_gone_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", None), (None, 4, "x", "b.", True)], COLUMNS + ", gone boolean")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(rows, gone=F.col("gone")).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[1] == got[None] == nothing and got[2][5:7] == (3, "KI")
    assert repair_conversations(spark.createDataFrame([], COLUMNS)).collect() == []
    assert damage(spark.createDataFrame([(None, None, None, None)] * 3, COLUMNS)).count() in (3, 6)


def test_query_on_messy_conversations(spark, tmp_path):
    """Damage and repair of null, repeated and tied rows against the query's SQL."""
    rows = [(c * 100 if c is not None else None, t, r, x) for c, t, r, x in ROWS if c != 3] + [(k, t, "user" if t % 2 == 0 else "assistant", f"{k} {t}.") for k in range(200, 260) for t in range(6)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(ORACLES["op12_conversation_repair"])
    found = QUERIES["op12_conversation_repair"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want.fetchall()))

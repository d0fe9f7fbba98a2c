"""Restore (T2-T7) and exact admission (T8-T10) against brute force."""
from collections import deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def _session(masker, text, owner="principal-a"):
    from textguard.operators.masking import anonymize
    rows, out = masker([text])
    return rows[0], out


def test_roundtrip_owner_ttl_shape_and_amplification(spark):
    from textguard.operators.masking import anonymize
    from textguard.operators.vault import restore
    docs = spark.createDataFrame([(1, "max@example.com und max@example.com", "principal-a"),
                                  (2, "Kontakt ab@cdefghij.example.com", None)], "id long, text string, owner string")
    a = anonymize(docs, "text", key_cols=["id"], principal_col="owner", created_at=T0)
    m = {r.id: r for r in a.masked.collect()}
    s1, s2 = m[1].session_id, m[2].session_id
    big = "<EMAIL_ADDRESS_0>" * 5000  # 85,000 bytes in, > 100 KiB out
    reqs = [
        ("ok", s1, "principal-a", m[1].anonymized_text, T0),
        ("other", s1, "principal-b", "<EMAIL_ADDRESS_0>", T0),
        ("no_owner_caller", s1, None, "<EMAIL_ADDRESS_0>", T0),
        ("ownerless", s2, "anyone", "An <EMAIL_ADDRESS_0>", T0 + timedelta(seconds=3600)),
        ("expired", s2, "anyone", "x", T0 + timedelta(seconds=3601)),
        ("upper", s1.upper(), "principal-a", "x", T0),
        ("bad", "bad", "principal-a", "x", T0),
        ("blowup", s2, None, big, T0),
        ("too_big_in", s2, None, "x" * (100 * 1024 + 1), T0),
    ]
    rq = spark.createDataFrame(reqs, "kind string, session_id string, principal_id string, text string, ts timestamp")
    got = {r.kind: r for r in restore(rq, a.mapping).collect()}
    assert got["ok"].restored_text == "max@example.com und max@example.com" and got["ok"].error is None
    assert got["other"].error.code == "session_not_authorized"
    assert got["no_owner_caller"].error.code == "session_not_authorized"
    assert got["ownerless"].restored_text == "An ab@cdefghij.example.com"
    assert got["expired"].error.code == "session_not_found"
    assert got["upper"].error.code == "session_not_found" and got["bad"].error.code == "session_not_found"
    assert got["blowup"].error.code == "resource_too_large"
    assert got["too_big_in"].error.code == "resource_too_large"
    edge = {r.kind: r for r in restore(rq, a.mapping, at_edge=True).collect()}
    assert edge["bad"].error.code == "validation_error" and edge["too_big_in"].error.code == "validation_error"


def brute_admit(ts, limit, window, keep_equal):
    log, out = deque(), []
    for t in ts:
        while log and ((t - log[0] > window) if keep_equal else (log[0] <= t - window)):
            log.popleft()
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out


def test_rate_limit_and_session_quota_equal_brute_force(spark):
    from tests.conftest import SF_SMALL
    from textguard.operators import quotas as Q
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "user_id", "ts")
    rows = ev.collect()
    by_user = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        by_user.setdefault(r.user_id, []).append(r)
    for fn, keep_equal in ((Q.rate_limit, False), (Q.session_quota, True)):
        kw = {"max_calls": 2, "window_seconds": 86400} if fn is Q.rate_limit else {"max_sessions": 2, "ttl_seconds": 86400}
        got = {r.event_id: r.accepted for r in fn(ev, "user_id", "ts", "event_id", **kw).collect()}
        for uid, evs in by_user.items():
            us = [int(e.ts.timestamp() * 1e6) for e in evs]
            exp = brute_admit(us, 2, 86400 * 10**6, keep_equal)
            assert [got[e.event_id] for e in evs] == exp


def test_limiter_rejects_second_call_and_boundaries(spark):
    from textguard.operators import quotas as Q
    rows = [(1, "p", T0), (2, "p", T0 + timedelta(seconds=30)), (3, "p", T0 + timedelta(seconds=60)),
            (4, "q", T0)]
    df = spark.createDataFrame(rows, "id long, principal string, ts timestamp")
    got = {r.id: r.accepted for r in Q.rate_limit(df, "principal", "ts", "id", max_calls=1, window_seconds=60).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}  # age exactly 60 s has left the window
    got = {r.id: r.accepted for r in Q.session_quota(df, "principal", "ts", "id", max_sessions=1, ttl_seconds=60).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}  # age exactly 60 s is still live


def test_global_quota_bytes_and_count(spark):
    from textguard.operators import quotas as Q
    rows = [(i, T0 + timedelta(seconds=i), s) for i, s in enumerate([40, 40, 40, 10, 200])]
    df = spark.createDataFrame(rows, "id long, ts timestamp, size long")
    got = [r.accepted for r in Q.global_quota(df, "ts", "id", "size", max_sessions=3, ttl_seconds=3600, max_bytes=100).orderBy("id").collect()]
    assert got == [True, True, False, True, False]


def test_hot_key_is_split_and_still_exact(spark):
    """One principal holds most calls; range partitioning spreads it over all partitions and the
    carry-in fixed point keeps every decision equal to the sequential fold."""
    import random
    from textguard.operators import quotas as Q
    rnd = random.Random(7)
    rows, t = [], 0
    for i in range(6000):
        t += rnd.choice([1, 2, 5, 30, 400])
        rows.append((i, "hot" if rnd.random() < 0.8 else f"u{rnd.randint(0, 20)}", T0 + timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "id long, principal string, ts timestamp")
    got = {r.id: r.accepted for r in Q.rate_limit(df, "principal", "ts", "id", max_calls=5, window_seconds=120).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for evs in by.values():
        evs.sort(key=lambda r: (r[2], r[0]))
        exp = brute_admit([int(e[2].timestamp() * 1e6) for e in evs], 5, 120 * 10**6, False)
        assert [got[e[0]] for e in evs] == exp


def test_saturated_key_over_200_parts_and_any_later_partitioning(spark):
    """One call a second against 7 per 50 s never lets the state empty; the decisions must not change when
    the result is coalesced, or read as the second side of a union."""
    from textguard.operators import quotas as Q
    rows = [(i, "hot" if i % 9 else "calm", T0 + timedelta(seconds=i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, principal string, ts timestamp").repartition(5)
    out = Q.sliding_admission(df, ["principal"], "ts", "id", limit=7, window_seconds=50, keep_equal_age=False, num_partitions=200)
    exp = {}
    for who in ("hot", "calm"):
        own = [r for r in rows if r[1] == who]
        exp.update(zip([r[0] for r in own], brute_admit([int(r[2].timestamp() * 1e6) for r in own], 7, 50 * 10**6, False)))
    for shape in (out, out.coalesce(1), out.repartition(3), df.limit(0).selectExpr("*", "true AS accepted", "'' AS error_code").unionByName(out)):
        assert {r.id: r.accepted for r in shape.collect()} == exp


def test_session_admission_applies_all_rules_in_order(spark):
    import random
    from textguard.operators import quotas as Q
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(1500):
        t += rnd.choice([1, 3, 10, 60, 900])
        rows.append((i, rnd.choice(["a", "a", "a", "b", None]), T0 + timedelta(seconds=t), rnd.choice([10, 40, 90, 400])))
    df = spark.createDataFrame(rows, "id long, who string, ts timestamp, size long")
    live, exp = [], {}
    for i, who, ts, size in rows:
        live = [e for e in live if ts - e[0] <= timedelta(seconds=600)]
        if size > 300:
            exp[i] = "resource_too_large"
        elif sum(e[1] == who for e in live) >= 3 or len(live) >= 6 or sum(e[2] for e in live) + size > 300:
            exp[i] = "privacy_session_capacity_exhausted"
        else:
            exp[i] = None
            live.append((ts, who, size))
    out = Q.session_admission(df, "who", "ts", "id", "size", max_per_principal=3, max_sessions=6, ttl_seconds=600, max_bytes=300).collect()
    assert {r.id: r.error_code for r in out} == exp and all(r.accepted == (r.error_code is None) for r in out)
    assert len(set(exp.values())) == 3


def test_passing_rejected_runs_equals_the_rules_call_by_call():
    """A saturated log rejects long runs; each call keeps the code of the first rule that it breaks, also over a cut."""
    import random
    import numpy as np
    from textguard.operators import quotas as Q
    for seed in range(30):
        rnd = random.Random(seed)
        keep, n, gap = bool(seed % 2), 700, rnd.choice([1, 3, 40])
        ts = np.cumsum([rnd.randint(0, gap) for _ in range(n)])
        sizes = np.array([rnd.choice([0, 10, 60, 101, 500]) for _ in range(n)])
        owners = np.array([rnd.choice(["a", "b", "c", None]) for _ in range(n)], dtype=object)
        live, exp = [], []
        for t, size, who in zip(ts, sizes, owners):
            live = [e for e in live if (t - e[0] <= 90 if keep else e[0] > t - 90)]
            if size > 100:
                exp.append(Q.TOO_LARGE)
            elif sum(e[2] == who for e in live) >= 2:
                exp.append(Q.OWNER_FULL)
            elif len(live) >= 4 or sum(e[1] for e in live) + size > 100:
                exp.append(Q.FULL)
            else:
                exp.append(Q.ACCEPTED)
                live.append((t, size, who))
        cut, state, got = rnd.randint(0, n), None, []
        for part in (slice(0, cut), slice(cut, n)):
            out, state = Q.admit_sequence(ts[part], 4, 90, keep, sizes[part], 100, state, owners[part], 2)
            got += out.tolist()
        assert got == exp


def test_states_are_found_without_the_callers_columns(spark, monkeypatch):
    """Rounds store exit states only; the caller's columns are written with the calls and with their outcome."""
    from textguard.operators import quotas as Q
    stored, real = [], Q.written

    def noted(df, name):
        stored.append((name, df.columns))
        return real(df, name)

    monkeypatch.setattr(Q, "written", noted)
    df = spark.range(1500).selectExpr("id", "timestamp_seconds(id) AS ts", "id % 7 AS size", "repeat('x', 50) AS note")
    out = Q.global_quota(df, "ts", "id", "size", max_sessions=9, ttl_seconds=100, max_bytes=30)
    live, exp = [], {}
    for i in range(1500):
        live = [e for e in live if i - e[0] <= 100]
        exp[i] = len(live) < 9 and sum(e[1] for e in live) + i % 7 <= 30
        live += [(i, i % 7)] if exp[i] else []
    assert {r.id: r.accepted for r in out.collect()} == exp
    assert out.columns == ["id", "ts", "size", "note", "accepted", "error_code"]
    assert [name for name, columns in stored if "note" in columns] == ["admission-calls", "admission"]
    assert sum(name == "admission-exits" for name, _ in stored) > 1


def test_restore_on_a_stream_matches_batch(spark):
    """Responses arriving as a stream are restored by a stream-static left join with the mappings."""
    import os
    import tempfile
    from textguard.operators.masking import anonymize
    from textguard.operators.vault import restore
    from textguard.streaming.pipelines import run_available_now
    docs = spark.createDataFrame([(1, "max@example.com", "a"), (2, "B-AB 12 and x@y.de", "b")], "id long, text string, owner string")
    a = anonymize(docs, "text", key_cols=["id"], principal_col="owner", created_at=T0, reuse=True)
    req = a.masked.select("id", "session_id", F.col("owner").alias("principal_id"),
                          F.col("anonymized_text").alias("text"), F.lit(T0).cast("timestamp").alias("ts"))
    d = tempfile.mkdtemp(prefix="tg-req-")
    req.write.mode("overwrite").parquet(os.path.join(d, "r"))
    stream = spark.readStream.schema(req.schema).parquet(os.path.join(d, "r"))
    got = {r.id: r.restored_text for r in run_available_now(restore(stream, a.mapping), "restore").collect()}
    assert got == {1: "max@example.com", 2: "B-AB 12 and x@y.de"}


def test_release_persisted_pass(spark):
    from textguard.operators.masking import anonymize
    a = anonymize(spark.createDataFrame([(1, "a@b.de")], "id long, text string"), "text", key_cols=["id"], reuse=True)
    assert a.masked.count() == 1 and a.mapping.count() == 1
    assert a.shared is not None and a.shared.storageLevel.useMemory
    a.release()
    assert not a.shared.storageLevel.useMemory

"""Stateful streams: restore as a stream-stream join, admission with late calls, refused options."""

import datetime as dt
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textguard.operators import quotas as Q
from textguard.operators.masking import anonymize
from textguard.operators.vault import restore
from textguard.streaming import pipelines as S

T0 = dt.datetime(2024, 1, 1)
MAPPING = "session_id string, principal_id string, created_at timestamp, size_bytes long, mappings array<struct<placeholder:string,value:string>>"
REQUEST = "id long, session_id string, principal_id string, text string, ts timestamp"


def sid(k):
    return "00000000-0000-4000-8000-%012d" % k


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def arrive(spark, batches, schemas, make, name):
    """Each batch holds rows for every source; the stream is restarted for every batch. Returns the rows known after each."""
    base = tempfile.mkdtemp(prefix=f"tg-{name}-")
    seen = []
    for k, sources in enumerate(batches):
        for side, (rows, schema) in enumerate(zip(sources, schemas)):
            spark.createDataFrame(rows, schema).write.parquet(f"{base}/in{side}/slice-{k}")
        streams = [S.file_stream(spark, f"{base}/in{side}/*", spark.createDataFrame([], schema)) for side, schema in enumerate(schemas)]
        seen.append(S.run_available_now(make(*streams), name, base=f"{base}/run").collect())
    return seen


def test_restore_stream_answers_every_response(spark):
    """Sessions and responses in any order over four batches; age 3,600 s lives, 3,601 s does not; unknown ids wait for the watermark."""
    sessions = {k: (sid(k), "ann" if k == 2 else None, at(0), 1, [("<A_0>", f"value {k}")]) for k in (1, 2, 3)}
    requests = [
        (1, sid(1), None, "<A_0>", at(3600)), (2, sid(1), None, "<A_0>", at(3601)), (3, sid(2), "ann", "to <A_0>.", at(5)), (4, sid(2), "bob", "<A_0>", at(5)),
        (5, sid(9), None, "x", at(10)), (6, "not an id", None, "x", at(10)), (7, sid(3), None, "y" * 200_000, at(10)), (8, sid(3), None, "early <A_0>", at(20)), (9, sid(3), None, None, at(10)),
    ]
    beat = ("", None, at(90_000), 0, None), (None, "", None, None, at(90_000))
    batches = [([requests[0], requests[7], requests[4]], [sessions[1]]), (requests[1:4], [sessions[2]]), (requests[5:7] + requests[8:], [sessions[3]]), ([beat[1]], [beat[0]]), ([beat[1]], [beat[0]])]
    seen = arrive(spark, batches, (REQUEST, MAPPING), lambda r, m: S.restore_stream(r, m, lateness="2 hours"), "restore")
    answers = [{r["id"]: (r["restored_text"], r["error"] and r["error"]["code"]) for r in rows if r["id"]} for rows in seen]
    assert set(answers[0]) == {1} and set(answers[1]) == {1, 3, 4}
    assert set(answers[2]) == {1, 3, 4, 6, 7, 8, 9}, "malformed, oversized and missing texts are answered at once; 8 once its session has come"
    batch = restore(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(list(sessions.values()), MAPPING))
    assert answers[-1] == {r["id"]: (r["restored_text"], r["error"] and r["error"]["code"]) for r in batch.collect()}
    assert answers[-1][1] == ("value 1", None) and answers[-1][2] == (None, "session_not_found") == answers[-1][5]
    ids = [r["id"] for r in seen[-1] if r["id"]]
    assert len(ids) == len(set(ids))


CALLS = "id long, who string, ts timestamp, size long"


def test_late_calls_are_decided(spark):
    """Calls behind the watermark get a decision; the log keeps their place in time."""
    batches = [([(1, "a", at(100), 1), (2, "b", at(100), 1)],), ([(3, "a", at(5000), 1)],), ([(4, "a", at(90), 1), (5, "c", at(1), 1)],), ([(6, "a", at(4990), 1), (7, "b", at(4995), 1), (8, "a", at(4999), 1)],)]
    seen = arrive(spark, batches, (CALLS,), lambda s: S.admission_state(s, "who", "ts", "id", limit=2, window_seconds=60, keep_equal_age=False), "late")
    assert {r["id"]: r["accepted"] for r in seen[-1]} == dict.fromkeys(range(1, 8), True) | {8: False}


def test_session_admission_on_a_stream(spark):
    """Own size, owner cap, vault caps and bytes as in batch; owners unknown share a quota; late creates are decided."""
    rows = [(1, "a", at(0), 10), (2, "a", at(1), 10), (3, "a", at(2), 10), (4, None, at(3), 99), (5, None, at(4), 60), (6, "b", at(5), 20), (7, "c", at(6), 5),
            (8, "c", at(60), 5), (9, "a", at(61), 1), (10, "a", at(62), 1), (11, None, at(63), 5), (12, None, at(64), 5), (13, None, at(65), 1)]
    options = dict(max_per_principal=2, max_sessions=4, ttl_seconds=60, max_bytes=90)
    batches = [(rows[:3],), (rows[3:6],), (rows[6:10],), (rows[10:],), ([(14, "late", at(-500), 1), (15, "late", at(-501), 91)],)]
    seen = arrive(spark, batches, (CALLS,), lambda s: S.session_admission_state(s, "who", "ts", "id", "size", **options), "sessions")
    want = Q.session_admission(spark.createDataFrame(rows, CALLS).fillna("?", ["who"]), "who", "ts", "id", "size", **options).select("id", "accepted", "error_code")
    assert sorted(map(tuple, seen[3])) == sorted(map(tuple, want.collect()))
    late = {r["id"]: r["error_code"] for r in seen[4]}
    assert len(seen[4]) == 15 and late[15] == "resource_too_large" and 14 in late


def test_vaults_are_kept_apart(spark):
    rows = [(k, "a", at(k), 1) for k in range(6)]
    seen = arrive(spark, [(rows,)], (CALLS,), lambda s: S.session_admission_state(s.withColumn("v", F.col("id") % 2), "who", "ts", "id", "size", vault_col="v", max_per_principal=2), "vaults")
    assert {r["id"] for r in seen[0] if r["accepted"]} == {0, 1, 2, 3}


def test_streams_without_keys_are_refused(spark):
    base = tempfile.mkdtemp(prefix="tg-keyless-")
    spark.createDataFrame([("a@b.de",)], "text string").write.parquet(f"{base}/in/a")
    stream = S.file_stream(spark, f"{base}/in/*", spark.createDataFrame([], "text string"))
    with pytest.raises(ValueError, match="key_cols"):
        anonymize(stream, "text")
    with pytest.raises(ValueError, match="key_cols"):
        S.mask_stream(stream, "text", f"{base}/out")
    assert [tuple(r) for r in S.run_available_now(S.entity_counts(stream), "keyless", "complete").collect()] == [("EMAIL_ADDRESS", 1)]


def test_calls_of_a_fold_are_narrow_arrays(spark):
    """Owners are numbers, rows that only carry a time never reach the fold, and answers leave in short frames."""
    batches = [pd.DataFrame({"_tg_us": [5, 3], "event_id": [2, 1], "_tg_owner": ["a", "b"], "_tg_time": [None, None]}),
               pd.DataFrame({"_tg_us": [3, 1], "event_id": [0, 9], "_tg_owner": ["a", "c"], "_tg_time": [None, None]})]
    calls, owners = S._in_order(iter(batches), "event_id", "_tg_owner")
    assert calls["event_id"].tolist() == [9, 0, 1, 2] and calls["_tg_us"].tolist() == [1, 3, 3, 5]
    assert calls["_tg_owner"].dtype.kind == "i" and [owners[i] for i in calls["_tg_owner"]] == ["c", "a", "b", "a"] and "_tg_time" not in calls
    text, _ = S._in_order(iter([pd.DataFrame({"_tg_us": [1, 1], "event_id": ["b", "a"], "_tg_time": [None, None]})]), "event_id")
    assert text["event_id"].tolist() == ["a", "b"]
    frames = list(S._answers({"event_id": np.arange(S.ANSWER_ROWS + 1)}))
    assert [len(f) for f in frames] == [S.ANSWER_ROWS, 1]
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "event_id long, ts timestamp")
    staged = S._calls(rows, "ts", "0 seconds", event_id=F.col("event_id")).collect()
    assert [(r.event_id, r._tg_time) for r in staged] == [(1, None)]

"""Queries for restore and session admission with everything arriving as streams."""

from __future__ import annotations

import os
import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from textguard.operators.quotas import epoch_micros
from textguard.plans.audit_queries import _arriving
from textguard.plans.registry import ORACLES, query, releasing
from textguard.plans.vault_queries import SA_BYTES, SA_LIMIT, SA_OWNER, SA_TTL, T0, _kind, _masked, requests_for
from textguard.session import checkpoint_dir
from textguard.sources.tables import read_table
from textguard.streaming import pipelines as S


@query("restore_stream", ORACLES["restore_errors"])
@releasing
def restore_stream(spark, sf_dir):
    """Sessions and responses arrive in four micro-batches each, in different orders, with a restart after each.

    A fifth batch two days later moves both watermarks, so the sixth answers what still waits for its session.
    """
    a = _masked(spark, sf_dir)
    requests = requests_for(a).withColumn("ts", F.col("ts").cast("timestamp"))
    mapping = a.mapping
    base = os.path.join(checkpoint_dir(spark), f"arriving-restore-{uuid.uuid4().hex}")
    later = F.lit(T0 + timedelta(days=2)).cast("timestamp")

    def beat(like, time):
        set_to = {time: later, "session_id": F.lit("")}  # no request's id
        return spark.range(1).select(*[set_to.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])

    for i in range(6):
        for side, rows, turn, time in (("requests", requests, F.col("doc_id") % 4, "ts"), ("sessions", mapping, F.floor(F.col("doc_id") / 4) % 4, "created_at")):
            (rows.where(turn == i) if i < 4 else beat(rows, time)).write.parquet(f"{base}/{side}/slice-{i}")
        streams = [S.file_stream(spark, f"{base}/{side}/*", like) for side, like in (("requests", requests), ("sessions", mapping))]
        out = S.run_available_now(S.restore_stream(*streams, lateness="2 hours"), "restore", base=f"{base}/run")
    return out.where("doc_id IS NOT NULL").select("doc_id", _kind().cast("long").alias("kind"), F.col("error.code").alias("error_code"), "restored_text")


@query("session_admission_stream", ORACLES["session_admission"])
def session_admission_stream(spark, sf_dir):
    """T8 + T9 as state of one vault over four micro-batches, restarted after each: the decisions of the batch fold."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (100 + (F.col("event_id") % 50) * 125).alias("size_bytes"))
    at = epoch_micros(events, "ts")
    first, last = events.agg(F.min(at), F.max(at)).first()
    quarter = F.least(F.floor((at - F.lit(first)) * 4 / F.lit(max(1, last - first))), F.lit(3))

    def decide(stream):
        return S.session_admission_state(stream, "user_id", "ts", "event_id", "size_bytes", max_per_principal=SA_OWNER, max_sessions=SA_LIMIT,
                                         ttl_seconds=SA_TTL, max_bytes=SA_BYTES)

    return _arriving(spark, events, quarter, decide, "session-admission")

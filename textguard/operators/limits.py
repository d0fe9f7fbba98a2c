"""Masking calls under the caller's limits: rate limit before any work, session caps when a session is created."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard import errors as E
from textguard.operators import quotas as Q
from textguard.operators.masking import Anonymized, anonymize


def _decided(rows: DataFrame, decisions: DataFrame, id_col: str) -> DataFrame:
    """The rows with ``accepted`` and ``error_code`` of their id."""
    d = decisions.select(F.col(id_col).alias("_tg_call"), "accepted", "error_code")
    return rows.join(d, F.col(id_col).eqNullSafe(F.col("_tg_call"))).drop("_tg_call")


def anonymize_calls(
    calls: DataFrame,
    text_col: str = "text",
    *,
    id_col: str,
    principal_col: str,
    ts_col: str,
    max_calls: int = Q.RATE_LIMIT_CALLS,
    window_seconds: float = Q.RATE_LIMIT_WINDOW_S,
    max_per_principal: int = Q.SESSIONS_PER_PRINCIPAL,
    max_sessions: int = Q.MAX_SESSIONS,
    ttl_seconds: float = Q.SESSION_TTL_S,
    max_bytes: int = Q.MAX_VAULT_BYTES,
    **options,
) -> Anonymized:
    """Every call is a row error or a masked text, as if the calls came in the order of (ts, id).

    A call beyond the rate limit is ``rate_limit_exceeded`` and its text is not scanned. A reversible call that
    would create a session beyond a cap is ``privacy_session_capacity_exhausted`` (``resource_too_large`` if its
    mapping alone exceeds the bytes): no masked text, no mapping row, nothing counted. ``id_col`` is unique per call.
    The folds of the limits store ids, owners, times and sizes only, never a text or a mapped value. Call ``release()``
    after use.
    """
    decisions = Q.rate_limit(calls.select(id_col, principal_col, ts_col), principal_col, ts_col, id_col, max_calls=max_calls, window_seconds=window_seconds)
    decided = _decided(calls, decisions, id_col)
    a = anonymize(decided.where("accepted").drop("accepted", "error_code"), text_col, key_cols=[id_col], principal_col=principal_col,
                  created_at=ts_col, reuse=StorageLevel.DISK_ONLY, spread_input=False, **options)
    creates = Q.session_admission(a.mapping.select(id_col, "principal_id", "created_at", "size_bytes"), "principal_id", "created_at", id_col, "size_bytes",
                                  max_per_principal=max_per_principal, max_sessions=max_sessions, ttl_seconds=ttl_seconds, max_bytes=max_bytes)
    mapping = _decided(a.mapping, creates, id_col).where("accepted").drop("accepted", "error_code")
    refused = creates.where("not accepted").select(id_col, F.when(
        F.col("error_code") == E.RESOURCE_TOO_LARGE, E.error(E.RESOURCE_TOO_LARGE)).otherwise(E.error(E.SESSION_CAPACITY)).alias("_tg_refused"))
    rows = a.masked.join(refused, id_col, "left")
    ok = F.col("_tg_refused").isNull()
    result = {"anonymized_text", "pii_count", "session_id", "strategy", "entities"}
    masked = rows.select(*[F.when(ok, F.col(c)).alias(c) if c in result else F.coalesce("error", "_tg_refused").alias(c) if c == "error" else F.col(c) for c in a.masked.columns])
    limited = decided.where("not accepted").drop("accepted", "error_code").withColumn("error", E.error(E.RATE_LIMIT_EXCEEDED))
    return Anonymized(masked.unionByName(limited, allowMissingColumns=True), mapping, a.shared)

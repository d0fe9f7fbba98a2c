"""Mapping restore (T2-T7): a left equi-join of responses with mapping rows, then checks and replacement.

The mapping table is the ``mapping`` output of ``anonymize``. Restore requests are
``(session_id, text, principal_id, ts)`` rows. Hot sessions (one id restored many times)
are a skewed join key on the request side only; AQE's skew-join handling splits those
partitions, and the mapping side holds one row per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import errors as E
from textguard.operators import validate as V

DEFAULT_TTL_SECONDS = 3600
MAX_RESTORE_BYTES = 100 * 1024


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def replace_longest_first(text: Column, mappings: Column, max_bytes: int) -> Column:
    """Sequential ``replace`` of each placeholder, longest key first (stable for equal lengths).

    Returns ``struct(text, too_large)``; ``too_large`` is set as soon as any intermediate
    text exceeds ``max_bytes`` (the check runs after every single replacement).
    """
    indexed = F.transform(mappings, lambda m, i: F.struct(m["placeholder"].alias("k"), m["value"].alias("v"), i.alias("i")))
    ordered = F.array_sort(indexed, lambda a, b: (
        F.when(F.char_length(a["k"]) > F.char_length(b["k"]), -1)
        .when(F.char_length(a["k"]) < F.char_length(b["k"]), 1)
        .when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)))

    def step(acc, m):
        nxt = F.replace(acc["t"], m["k"], m["v"])
        return F.when(acc["bad"], acc).otherwise(
            F.struct(nxt.alias("t"), (F.octet_length(nxt) > max_bytes).alias("bad")))

    init = F.struct(text.alias("t"), F.lit(False).alias("bad"))
    return F.aggregate(ordered, init, step)


def restore(
    requests: DataFrame,
    mapping: DataFrame,
    *,
    text_col: str = "text",
    session_col: str = "session_id",
    principal_col: str | None = "principal_id",
    ts_col: str = "ts",
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    max_restore_bytes: int = MAX_RESTORE_BYTES,
    at_edge: bool = False,
) -> DataFrame:
    """Adds ``restored_text`` and ``error`` to every request row.

    Error precedence (first failing check wins): text size -> id shape -> unknown or
    expired (age > ttl; a request older than the session is unknown) -> owner ->
    amplification. With ``at_edge=True`` the first two map to ``validation_error`` as at
    the tool boundary, and an empty text is one too; otherwise they are vault errors.
    """
    m = sessions(mapping)
    req = keyed(requests, session_col)
    j = req.join(m, req["_tg_key"] == m["_tg_sid"], "left")
    age = _micros(F.col(ts_col)) - _micros(F.col("_tg_created"))
    found = F.col("_tg_sid").isNotNull() & (age >= 0) & (age <= F.lit(int(ttl_seconds * 1_000_000)).cast("long"))
    return answered(j, found, text_col, principal_col, max_restore_bytes, at_edge)


def sessions(mapping: DataFrame) -> DataFrame:
    return mapping.select(
        F.col("session_id").alias("_tg_sid"),
        F.col("principal_id").alias("_tg_owner"),
        F.col("created_at").alias("_tg_created"),
        F.col("mappings").alias("_tg_maps"),
    )


def keyed(requests: DataFrame, session_col: str) -> DataFrame:
    """Only well-formed ids can match; malformed ones get no join key (null never joins)."""
    req = requests.withColumn("_tg_idok", V.session_id_ok(F.col(session_col)))
    return req.withColumn("_tg_key", F.when(F.col("_tg_idok"), F.col(session_col)))


def answered(j: DataFrame, found: Column, text_col: str, principal_col: str | None, max_restore_bytes: int, at_edge: bool) -> DataFrame:
    """Restored text or error of every request that was joined with the session it names (``found``: a live one)."""
    text = F.col(text_col)
    caller = F.col(principal_col) if principal_col else F.lit(None).cast("string")
    owner_ok = F.col("_tg_owner").isNull() | (F.col("_tg_owner") == F.coalesce(caller, F.lit("\u0000")))
    size_code = E.VALIDATION_ERROR if at_edge else E.RESOURCE_TOO_LARGE
    id_code = E.VALIDATION_ERROR if at_edge else E.SESSION_NOT_FOUND

    j = j.withColumn("_tg_r", F.when(found & owner_ok & (F.octet_length(text) <= max_restore_bytes),
                                     replace_longest_first(text, F.col("_tg_maps"), max_restore_bytes)))
    err = E.first_error(
        (text.isNull() | (F.octet_length(text) > max_restore_bytes) | (F.lit(at_edge) & (F.octet_length(text) == 0)), size_code),
        (~F.col("_tg_idok"), id_code),
        (~found, E.SESSION_NOT_FOUND),
        (~owner_ok, E.SESSION_NOT_AUTHORIZED),
        (F.col("_tg_r.bad"), E.RESOURCE_TOO_LARGE),
    )
    out = j.withColumn("error", err).withColumn("restored_text", F.when(F.col("error").isNull(), F.col("_tg_r.t")))
    return out.drop("_tg_idok", "_tg_key", "_tg_sid", "_tg_owner", "_tg_created", "_tg_maps", "_tg_r")

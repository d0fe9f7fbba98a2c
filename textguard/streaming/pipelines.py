"""Structured Streaming forms: masking + running counters (G6), restore as a stream-stream join (T2-T7), and the
rate limit and session quotas as keyed state (T8-T10) with ``applyInPandasWithState``.

Batch and streaming share the same operators: ``anonymize`` is a narrow projection and
runs unchanged on a streaming DataFrame; the admission fold is ``quotas.admit_sequence``.
"""

from __future__ import annotations

import os
import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textguard import errors as E
from textguard.operators.masking import anonymize
from textguard.operators.quotas import ACCEPTED, MAX_SESSIONS, MAX_VAULT_BYTES, SESSION_TTL_S, SESSIONS_PER_PRINCIPAL, admit_sequence, epoch_micros
from textguard.operators.vault import DEFAULT_TTL_SECONDS, MAX_RESTORE_BYTES, answered, keyed, sessions
from textguard.session import checkpoint_dir


def entity_counts(stream: DataFrame, text_col: str = "text", **anonymize_kwargs) -> DataFrame:
    """Running occurrences per entity type over a stream of texts (complete/update mode)."""
    if not anonymize_kwargs.get("key_cols"):
        anonymize_kwargs.setdefault("strategy", "redact")  # counts are the same, and no session ids are needed
    masked = anonymize(stream, text_col, keep_entities=True, **anonymize_kwargs).masked
    ents = masked.filter(F.col("error").isNull()).select(F.explode("entities").alias("e"))
    return ents.groupBy(F.col("e.etype").alias("etype")).agg(F.count(F.lit(1)).alias("n"))


#: Owner of calls without a principal: they share one quota.
NOBODY = "\u0000"


def _until(state: GroupState, last_us: int, window_us: int) -> None:
    """A key's state leaves once the watermark has passed its last admitted call by the window."""
    state.setTimeoutTimestamp(max((last_us + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def _calls(stream: DataFrame, ts_col: str, lateness: str, **named) -> DataFrame:
    """The narrow rows of the fold. Spark drops rows whose event time is behind the watermark, and a call must never be
    dropped: so every call is a row without event time, and a second row carries its time to move the watermark."""
    rows = stream.select(epoch_micros(stream, ts_col).alias("_tg_us"), *[c.alias(n) for n, c in named.items()])
    times = F.array(F.lit(None).cast("timestamp"), F.timestamp_micros("_tg_us"))
    return rows.withColumn("_tg_time", F.explode(times)).withWatermark("_tg_time", lateness).where("_tg_time IS NULL")


def _in_order(batches: Iterator[pd.DataFrame], id_col: str, owner_col: str | None = None) -> tuple[dict[str, np.ndarray], list]:
    """The micro-batch's calls of one key by (time, id), as plain arrays; an owner is its place in the list of owners."""
    owners: dict[str, int] = {}
    parts: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for name in batch.columns:
            if name == owner_col:
                parts.setdefault(name, []).append(np.fromiter((owners.setdefault(o, len(owners)) for o in batch[name]), np.int32, len(batch)))
            elif name != "_tg_time":
                parts.setdefault(name, []).append(batch[name].to_numpy())
    calls = {name: np.concatenate(parts.pop(name)) for name in list(parts)}
    if calls[id_col].dtype.kind in "iu":
        order = np.lexsort((calls[id_col], calls["_tg_us"]))
    else:
        order = pd.DataFrame({"us": calls["_tg_us"], "id": calls[id_col]}).sort_values(["us", "id"], kind="stable").index.to_numpy()
    for name in calls:
        calls[name] = calls[name][order]
    return calls, list(owners)


#: Decisions that leave a fold as one frame.
ANSWER_ROWS = 50_000


def _answers(columns: dict) -> Iterator[pd.DataFrame]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, ANSWER_ROWS):
        yield pd.DataFrame({name: col[at : at + ANSWER_ROWS] for name, col in columns.items()})


def admission_state(stream: DataFrame, key_col: str, ts_col: str, id_col: str, *, limit: int,
                    window_seconds: float, keep_equal_age: bool, lateness: str = "0 seconds") -> DataFrame:
    """T8/T10 on a stream: per key, the admitted timestamps still inside the window are the state.

    Rows of one key are sorted by (ts, id) inside each micro-batch; across batches the arrival order is the
    order of decisions, as for a live limiter. Every call gets a decision, however late: one behind the watermark meets
    what its key still holds. A key's state leaves when the watermark has passed its last admitted call by the window.
    """
    window_us = int(round(window_seconds * 1_000_000))
    staged = _calls(stream, ts_col, lateness, **{id_col: F.col(id_col), key_col: F.col(key_col)})
    out_schema = T.StructType([
        T.StructField(id_col, stream.schema[id_col].dataType),
        T.StructField(key_col, stream.schema[key_col].dataType),
        T.StructField("accepted", T.BooleanType()),
    ])
    state_schema = T.StructType([T.StructField("log", T.ArrayType(T.LongType()))])

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque((int(t), 0, None) for t in (state.get[0] if state.exists else []))
        calls, _ = _in_order(batches, id_col)
        flags, log = admit_sequence(calls["_tg_us"].astype(np.int64), limit, window_us, keep_equal_age, state=held)
        state.update(([e[0] for e in log],))
        _until(state, max(int(calls["_tg_us"][-1]), log[-1][0] if log else 0), window_us)
        yield from _answers({id_col: calls[id_col], key_col: calls[key_col], "accepted": flags == ACCEPTED})

    return staged.groupBy(key_col).applyInPandasWithState(
        fold, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def session_admission_state(stream: DataFrame, principal_col: str, ts_col: str, id_col: str, size_col: str, *, vault_col: str | None = None,
                            max_per_principal: int = SESSIONS_PER_PRINCIPAL, max_sessions: int = MAX_SESSIONS, ttl_seconds: float = SESSION_TTL_S,
                            max_bytes: int = MAX_VAULT_BYTES, lateness: str = "0 seconds") -> DataFrame:
    """T8 and T9 as one decision per create on a stream: ``quotas.session_admission`` as state of the vault.

    The state of a vault (all creates are one vault unless ``vault_col`` names it) holds time, size and owner of its
    live sessions, at most ``max_sessions``, and they leave by event time. A vault's creates are one sequence by the
    rule, so its narrow rows of a micro-batch meet in one task; the trigger's input limit bounds them. Order, late
    creates and the end of a state are those of ``admission_state``. Returns id, accepted, error_code.
    """
    window_us = int(round(ttl_seconds * 1_000_000))
    owner = F.coalesce(F.col(principal_col).cast("string"), F.lit(NOBODY))
    vault = F.col(vault_col) if vault_col else F.lit(0)
    staged = _calls(stream, ts_col, lateness, **{id_col: F.col(id_col), "_tg_owner": owner, "_tg_size": F.col(size_col).cast("long"), "_tg_vault": vault})
    out_schema = T.StructType([T.StructField(id_col, stream.schema[id_col].dataType), T.StructField("accepted", T.BooleanType()), T.StructField("error_code", T.StringType())])
    state_schema = T.StructType([T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("size", T.ArrayType(T.LongType())), T.StructField("owner", T.ArrayType(T.StringType()))])
    codes = np.array([None, E.RESOURCE_TOO_LARGE, E.SESSION_CAPACITY, E.SESSION_CAPACITY], dtype=object)

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls, owners = _in_order(batches, id_col, "_tg_owner")
        place = {o: i for i, o in enumerate(owners)}
        held = deque()
        for t, size, owner in zip(*state.get) if state.exists else ():
            if owner not in place:
                place[owner] = len(owners)
                owners.append(owner)
            held.append((int(t), int(size), place[owner]))
        outcome, log = admit_sequence(calls["_tg_us"].astype(np.int64), max_sessions, window_us, True, sizes=calls["_tg_size"].astype(np.int64), max_bytes=max_bytes,
                                      state=held, owners=calls["_tg_owner"], owner_limit=max_per_principal)
        state.update(([e[0] for e in log], [e[1] for e in log], [owners[e[2]] for e in log]))
        _until(state, max(int(calls["_tg_us"][-1]), log[-1][0] if log else 0), window_us)
        yield from _answers({id_col: calls[id_col], "accepted": outcome == ACCEPTED, "error_code": codes[outcome]})

    return staged.groupBy("_tg_vault").applyInPandasWithState(fold, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def restore_stream(requests: DataFrame, mapping: DataFrame, *, text_col: str = "text", session_col: str = "session_id", principal_col: str | None = "principal_id",
                   ts_col: str = "ts", ttl_seconds: int = DEFAULT_TTL_SECONDS, max_restore_bytes: int = MAX_RESTORE_BYTES, at_edge: bool = False,
                   lateness: str = "10 minutes") -> DataFrame:
    """T2-T7 with responses and sessions both arriving as streams: a left interval join on session id and age.

    Either side may come first within ``lateness``, the delay that both watermarks allow. A response that finds its
    live session is answered at once, as is one with a malformed id or an oversized text (it is never held). One whose
    session is unknown or too old gets ``session_not_found`` once the watermark has passed its time, as until then
    the session could still arrive. A session (and the values it maps) leaves the join's state when the watermark has
    passed its creation by the TTL. The watermark follows the slower side, so a side that stays silent holds it back.
    Rows further behind than ``lateness`` are dropped by Spark on either side: choose it no shorter than the delays
    that occur. State holds original values: keep the checkpoint on encrypted storage. Adds ``restored_text`` and ``error`` as ``vault.restore`` does.
    """
    m = sessions(mapping.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness))
    req = keyed(requests.withColumn("_tg_time", F.col(ts_col).cast("timestamp")).withWatermark("_tg_time", lateness), session_col)
    live = (F.col("_tg_time") >= F.col("_tg_created")) & (F.col("_tg_time") <= F.col("_tg_created") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
    fits = F.col("_tg_idok") & (F.octet_length(F.col(text_col)) <= max_restore_bytes)
    j = req.join(m, (req["_tg_key"] == m["_tg_sid"]) & live & fits, "left")
    return answered(j, F.col("_tg_sid").isNotNull(), text_col, principal_col, max_restore_bytes, at_edge).drop("_tg_time")


def run_available_now(df: DataFrame, name: str, output_mode: str = "append", base: str | None = None) -> DataFrame:
    """Drain a streaming query with ``availableNow`` into Parquet and return all that it has written so far.

    Every micro-batch overwrites the folder of its batch id, so a replayed batch replaces its own rows; in
    complete mode the latest batch is the result. ``base`` (a folder that executors share) holds these folders
    and the stream's checkpoint: a later call with the same ``base`` goes on where the earlier one stopped.
    """
    spark = df.sparkSession
    base = base or os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    out_path, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch_id}"))

    q = (df.writeStream.foreachBatch(write).outputMode(output_mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])
    try:
        rows = spark.read.schema(schema).parquet(out_path)
    except AnalysisException:  # no micro-batch ran: the stream was empty
        return spark.createDataFrame([], df.schema)
    if output_mode == "complete":
        latest = rows.agg(F.max("epoch")).first()[0]
        rows = rows.where(F.col("epoch") == latest) if latest is not None else rows
    return rows.drop("epoch")


def file_stream(spark: SparkSession, path: str, like: DataFrame, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(like.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def mask_stream(stream: DataFrame, text_col: str, out_path: str, *, checkpoint_path: str | None = None,
                mapping_path: str | None = None, available_now: bool = True, run_token: str | None = None, **anonymize_kwargs):
    """S4/S5 on a stream: mask every micro-batch and write the masked rows below ``out_path``; mapping rows go
    to ``mapping_path`` only when one is given.

    Each batch id writes its own folder in overwrite mode. Session ids derive from the run token and the row
    key, so a replayed batch rewrites the same rows only if a restart is given the same ``run_token``: it is
    required together with ``checkpoint_path`` and ``mapping_path``, and reversible masking needs ``key_cols`` (ids of
    rows without a key would be drawn anew by a replay). Returns the started query."""
    spark = stream.sparkSession
    if anonymize_kwargs.get("strategy", "placeholder") == "placeholder" and not anonymize_kwargs.get("key_cols"):
        raise ValueError("reversible masking of a stream needs key_cols: a replayed batch must give a row the same session id")
    if checkpoint_path and mapping_path and run_token is None:
        raise ValueError("a stream that restarts from a checkpoint needs a fixed run_token for its session ids")
    ckpt = checkpoint_path or os.path.join(checkpoint_dir(spark), f"mask-stream-{uuid.uuid4().hex}")
    token = run_token or uuid.uuid4().hex

    def write(batch: DataFrame, epoch_id: int) -> None:
        a = anonymize(batch, text_col, reuse=mapping_path is not None, run_token=token, **anonymize_kwargs)
        try:
            a.masked.write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch_id}"))
            if mapping_path is not None:
                a.mapping.write.mode("overwrite").parquet(os.path.join(mapping_path, f"epoch={epoch_id}"))
        finally:
            a.release()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()

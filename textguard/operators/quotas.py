"""Exact sliding-log admission per key: session quotas (T8, T9) and the rate limit.

Both rules are sequential per key: whether a call is admitted depends on the calls
admitted before it, and rejected calls are not logged. (A windowed ``count(*)`` over all
calls would also count rejected ones and over-reject.)

Batch plan. Calls are range-partitioned by (key, ts, id), which splits a hot key's timeline,
and written once to the shared folder in that order, with the partition's number and a place as
columns. A fold holds only the admitted calls still inside the window. A key that goes on from one
part into the next needs the exit state of the earlier part, so the states at the ends of parts
are found first: of each part only its last key's calls matter for that, as time, size and owner
in blocks, without the caller's columns. Every part starts from an empty state; parts whose carry-in
differs from the exit state before them are folded again, and only those that one key fills: all of
them at first, as states mostly converge (a quiet window empties them); then, from the first part of
each chain that is not settled, ``CHAIN`` parts in a row per task. A key that is saturated throughout
is sequential by its rule, so its chain takes one task after another, but no part is folded more than
a fixed number of times, no number of rounds is set, and the fold passes the calls that a full log
rejects in whole runs. With all carry-ins known, one last fold over all parts gives each call its outcome.
Only part numbers and hashes of keys and states reach the driver; states stay in files.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textguard import errors as E
from textguard.session import written

RATE_LIMIT_CALLS = 120
RATE_LIMIT_WINDOW_S = 60
SESSIONS_PER_PRINCIPAL = 100
MAX_SESSIONS = 1000
SESSION_TTL_S = 3600
MAX_VAULT_BYTES = 100 * 1024 * 1024


#: Outcomes of a call, in the order in which the rules are applied.
ACCEPTED, TOO_LARGE, OWNER_FULL, FULL = 0, 1, 2, 3
#: Parts of an unsettled chain that one task folds in a row, and rounds in which all unsettled parts are tried.
CHAIN, EAGER_ROUNDS = 32, 3
#: Calls of a block, and calls rejected in a row before the rest of a run is looked for.
BLOCK, PASS_AFTER = 4096, 8


def admit_sequence(ts_us: np.ndarray, limit: int, window_us: int, keep_equal_age: bool,
                   sizes: np.ndarray | None = None, max_bytes: int | None = None, state: deque | None = None,
                   owners: Sequence | None = None, owner_limit: int | None = None,
                   numbered: tuple[list, np.ndarray] | None = None) -> tuple[np.ndarray, deque]:
    """Fold over one key's calls in order. Returns (outcome per call, state).

    ``keep_equal_age=False`` (rate limit): an entry of age exactly ``window`` has left.
    ``keep_equal_age=True`` (session TTL): it is still live. The size of a call alone is
    checked first, then its owner's live calls, then all live calls and bytes.
    ``state`` holds (ts, size, owner) of admitted entries, oldest first. ``numbered``: the
    distinct owners and each call's place among them, if the caller has them.
    """
    log: deque = state if state is not None else deque()
    live_bytes = sum(e[1] for e in log)
    held = Counter(e[2] for e in log) if owner_limit is not None else None
    n = len(ts_us)
    out = np.zeros(n, dtype=np.int8)
    in_order = bool((ts_us[1:] >= ts_us[:-1]).all())
    index = {o: k for k, o in enumerate(numbered[0])} if numbered else {}  # else filled once a run is passed
    codes = numbered[1] if numbered else None
    i = row = 0  # row: calls rejected in a row
    while i < n:
        t = int(ts_us[i])
        while log and ((t - log[0][0] > window_us) if keep_equal_age else (log[0][0] <= t - window_us)):
            gone = log.popleft()
            live_bytes -= gone[1]
            if held is not None:
                held[gone[2]] -= 1
                if not held[gone[2]]:
                    del held[gone[2]]
        if row >= PASS_AFTER and in_order:
            if held is not None and codes is None:
                codes = np.fromiter((index.setdefault(o, len(index)) for o in owners), np.int64, n)
            full = np.zeros(len(index), dtype=bool)
            if held is not None:
                full[[index[o] for o, c in held.items() if c >= owner_limit and o in index]] = True
            end = n if not log else int(np.searchsorted(ts_us, log[0][0] + window_us, "right" if keep_equal_age else "left"))
            i = _pass_rejected(out, i, end, sizes, max_bytes, live_bytes, codes, full, len(log) >= limit)
            row = 0
            continue
        size = int(sizes[i]) if sizes is not None else 0
        owner = owners[i] if owners is not None else None
        row += 1
        if max_bytes is not None and size > max_bytes:
            out[i] = TOO_LARGE
        elif held is not None and held[owner] >= owner_limit:
            out[i] = OWNER_FULL
        elif len(log) >= limit or (max_bytes is not None and live_bytes + size > max_bytes):
            out[i] = FULL
        else:
            row = 0
            at = len(log)
            while at and log[at - 1][0] > t:  # a late call (streams only) takes its place in time
                at -= 1
            log.insert(at, (t, size, owner))
            live_bytes += size
            if held is not None:
                held[owner] += 1
        i += 1
    return out, log


def _pass_rejected(out: np.ndarray, i: int, end: int, sizes, max_bytes, live_bytes: int, codes, full: np.ndarray, log_full: bool) -> int:
    """Fills the outcomes from call ``i`` on up to the first call that fits, or to ``end``, where an entry leaves the log.

    Until then the state stays as it is, so the rules are compared for whole runs, whose width doubles.
    """
    width = 64
    while i < end:
        to = min(end, i + width)
        too_large = sizes[i:to] > max_bytes if max_bytes is not None else np.zeros(to - i, dtype=bool)
        owner_full = full[codes[i:to]] if codes is not None else np.zeros(to - i, dtype=bool)
        rejected = too_large | owner_full | log_full
        if max_bytes is not None:
            rejected |= sizes[i:to] > max_bytes - live_bytes
        run = to - i if rejected.all() else int(rejected.argmin())
        out[i : i + run] = np.where(too_large, TOO_LARGE, np.where(owner_full, OWNER_FULL, FULL))[:run]
        i += run
        if i < to:
            break
        width *= 2
    return i


def epoch_micros(df: DataFrame, col: str):
    """Microseconds since the epoch, independent of the session time zone.

    ``timestamp_ntz`` values are wall-clock readings: they are measured against the NTZ epoch
    directly, so daylight-saving shifts of the session zone cannot distort window ages.
    """
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col).cast("timestamp"))


#: Entries of a log: of a block's calls, and of a part's exit state.
_LOG = "c_t array<long>, c_s array<long>, c_o array<string>"
_STATE = ("c_t", "c_s", "c_o")
_BLOCK = f"_tg_part int, _tg_at long, {_LOG}"
_EXIT = f"_tg_part int, carry string, exit string, {_LOG}"


def _hash(x) -> str:
    """Names a state; the empty state has the empty name."""
    return md5(repr(x).encode()).hexdigest() if x else ""


def _numbers(col: pa.Array) -> np.ndarray:
    if col.null_count:
        raise ValueError("a call's time or size is null")
    return col.to_numpy(zero_copy_only=False)


def _in_blocks(schema: pa.Schema):
    """Calls in the order of their files (_tg_part, _tg_at, _tg_us, _tg_size, _tg_owner), ``BLOCK`` at most in one row."""
    def run(batches):
        for batch in batches:
            part, at = (batch.column(c).to_numpy() for c in ("_tg_part", "_tg_at"))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)) + 1
            starts = [a for lo, hi in zip([0, *cuts], [*cuts, len(part)]) for a in range(lo, hi, BLOCK)]
            offsets = pa.array([*starts, len(part)], pa.int32())
            _numbers(batch.column("_tg_us")), _numbers(batch.column("_tg_size"))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)).cast(schema.field(name).type) for c, name in zip(("_tg_us", "_tg_size", "_tg_owner"), _STATE)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(at[starts], pa.int64()), *lists], schema=schema)

    return run


def _fold_blocks(admit, schema: pa.Schema):
    """Fold blocks sorted by (_tg_grp, _tg_part, _tg_at); part -1 is a group's carry-in. One row per part: its exit state.

    The state goes on from part to part within a group.
    """
    def run(batches):
        grp = part = None
        carry, state = "", deque()

        def summary():
            values = [part, carry, _hash(list(state)), *([e[k] for e in state] for k in range(3))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            for i, (g, p) in enumerate(zip(batch.column("_tg_grp").to_pylist(), batch.column("_tg_part").to_pylist())):
                if part is not None and (p != part or g != grp):
                    yield summary()
                    part = None
                if g != grp:
                    grp, state = g, deque()
                ts, sizes, owners = (batch.column(c)[i].values for c in _STATE)
                if p < 0:
                    state = deque(zip(ts.to_pylist(), sizes.to_pylist(), owners.to_pylist()))
                    continue
                if part is None:
                    part, carry = p, _hash(list(state))
                _, state = admit(ts.to_numpy(), sizes.to_numpy(), state, owners)
        if part is not None:
            yield summary()

    return run


def _fold_calls(admit, schema: pa.Schema):
    """Fold calls sorted by (_tg_part, _tg_at), each part's keys from an empty state, its first key from the part's
    carry-in, if there is a row that holds it (_tg_at -1). Calls come back with their outcome."""
    def run(batches):
        part = key = None
        state, carried = deque(), None
        for batch in batches:
            parts, ats = batch.column("_tg_part").to_numpy(), batch.column("_tg_at").to_numpy()
            keys = batch.column("_tg_key").dictionary_encode()
            names, code = keys.dictionary, keys.indices.fill_null(-1).to_numpy()
            calls = ats >= 0
            outcome = np.zeros(batch.num_rows, dtype=np.int32)
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (code[1:] != code[:-1]) | ~calls[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]) if batch.num_rows else ():
                if not calls[a]:
                    held = json.loads(batch.column("_tg_carry")[int(a)].as_py())
                    carried = (parts[a], deque(zip(*(held[c] for c in _STATE))))
                    continue
                own = names[int(code[a])].as_py()
                if parts[a] != part:
                    state = carried[1] if carried and carried[0] == parts[a] else deque()
                elif own != key:
                    state = deque()
                part, key = parts[a], own
                ts, sizes = (_numbers(batch.column(c).slice(a, b - a)) for c in ("_tg_us", "_tg_size"))
                outcome[a:b], state = admit(ts, sizes, state, batch.column("_tg_owner").slice(a, b - a))
            known = {"_tg_outcome": pa.array(outcome)}
            yield pa.RecordBatch.from_arrays([known[f.name] if f.name in known else batch.column(f.name) for f in schema], schema=schema).filter(pa.array(calls))

    return run


def sliding_admission(
    df: DataFrame,
    key_cols: Sequence[str],
    ts_col: str,
    id_col: str,
    *,
    limit: int,
    window_seconds: float,
    keep_equal_age: bool,
    size_col: str | None = None,
    max_bytes: int | None = None,
    owner_col: str | None = None,
    owner_limit: int | None = None,
    full_code: str = E.SESSION_CAPACITY,
    num_partitions: int | None = None,
) -> DataFrame:
    """Adds ``accepted`` and ``error_code``: the exact sequential admission decision for every row.

    ``error_code`` is null, ``resource_too_large`` or ``full_code``. The result is an ordinary table
    over files in the shared folder: its rows do not depend on how the caller partitions it.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.to_json(F.struct(*[F.col(c) for c in key_cols])) if key_cols else F.lit("")
    order = ["_tg_key", "_tg_us", id_col]
    window_us = int(round(window_seconds * 1_000_000))

    def admit(ts, sizes, state, owners):
        if owner_limit is None:
            return admit_sequence(ts, limit, window_us, keep_equal_age, sizes, max_bytes, state)
        owners = owners.dictionary_encode()
        names = [*owners.dictionary.to_pylist(), None]
        codes = owners.indices.fill_null(len(names) - 1).to_numpy()
        return admit_sequence(ts, limit, window_us, keep_equal_age, sizes, max_bytes, state, np.array(names, dtype=object)[codes], owner_limit, (names, codes))

    calls = df.select(
        "*", key.alias("_tg_key"), epoch_micros(df, ts_col).alias("_tg_us"),
        (F.col(size_col).cast("long") if size_col else F.lit(0).cast("long")).alias("_tg_size"),
        (F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")).alias("_tg_owner"))
    dealt = calls.repartitionByRange(n, *order).sortWithinPartitions(*order)
    calls = written(dealt.withColumn("_tg_part", F.spark_partition_id()).withColumn("_tg_at", F.monotonically_increasing_id()), "admission-calls")
    ends = calls.groupBy("_tg_part").agg(F.min("_tg_key").alias("first"), F.max("_tg_key").alias("last"))
    ends = written(ends.coalesce(1), "admission-ends")  # a row per part
    last = F.broadcast(ends.select(F.col("_tg_part").alias("of"), "last"))
    tails = calls.join(last, (F.col("_tg_part") == F.col("of")) & (F.col("_tg_key") == F.col("last")))
    blocks = written(tails.select("_tg_part", "_tg_at", "_tg_us", "_tg_size", "_tg_owner").mapInArrow(_in_blocks(to_arrow_schema(T.StructType.fromDDL(_BLOCK))), _BLOCK), "admission-blocks")
    known = {r["_tg_part"]: r.asDict() for r in ends.select("_tg_part", F.md5("first").alias("first"), F.md5("last").alias("last")).collect()}  # names of keys only
    parts = sorted(known)
    before = {p: b for b, p in zip(parts, parts[1:]) if known[b]["last"] == known[p]["first"]}  # the part whose last key goes on in p
    exits: list[DataFrame] = []

    def states(of: dict[int, int]) -> DataFrame:
        """The exit states of parts, renamed to the part (or group) that they are carried into."""
        wanted = [(known[b]["turn"], b, to) for to, b in of.items()]
        rows = spark.createDataFrame(wanted, "turn int, _tg_part int, into int")
        every = reduce(DataFrame.unionByName, [e.withColumn("turn", F.lit(i)) for i, e in enumerate(exits)])
        return every.join(F.broadcast(rows), ["turn", "_tg_part"]).select("into", *_STATE)

    def fold(groups: list[tuple[int, int]]) -> None:
        again = spark.createDataFrame(groups, "_tg_part int, _tg_grp int")
        rows = blocks.where(F.col("_tg_part").isin([p for p, _ in groups])).join(F.broadcast(again), "_tg_part")  # a row per part
        starts = {g: before[g] for g in {g for _, g in groups} if known[g]["first"] == known[g]["last"] and g in before and known[before[g]].get("exit")}
        if starts:
            rows = rows.unionByName(states(starts).select(F.lit(-1).alias("_tg_part"), F.lit(-1).cast("long").alias("_tg_at"), *_STATE, F.col("into").alias("_tg_grp")))
        rows = rows.repartition(min(n, len(groups)), "_tg_grp").sortWithinPartitions("_tg_grp", "_tg_part", "_tg_at")
        exits.append(written(rows.mapInArrow(_fold_blocks(admit, to_arrow_schema(T.StructType.fromDDL(_EXIT))), _EXIT), "admission-exits"))
        for r in exits[-1].select("_tg_part", "carry", "exit").collect():
            known[r["_tg_part"]].update(carry=r["carry"], exit=r["exit"], turn=len(exits) - 1)  # names of states only

    if parts:
        fold([(p, p) for p in parts])
    while bad := {p for p, b in before.items() if known[p]["first"] == known[p]["last"] and known[p]["carry"] != known[b]["exit"]}:
        groups = [(p, p) for p in sorted(bad)]
        if len(exits) > EAGER_ROUNDS:  # only from the first unsettled part of each chain, some parts in a row
            groups, at = [], 0
            while at < len(parts):
                if parts[at] not in bad:
                    at += 1
                    continue
                start, length = at, 0
                while at < len(parts) and (at == start or parts[at] in before):
                    if length < CHAIN and (at == start or known[parts[at]]["first"] == known[parts[at]]["last"]):
                        groups.append((parts[at], parts[start]))
                    length, at = length + 1, at + 1
        fold(groups)
    own = [f.name for f in df.schema.fields]
    rows = calls.withColumn("_tg_carry", F.lit(None).cast("string"))
    if carries := {p: b for p, b in before.items() if known[b]["exit"]}:
        starts = states(carries).select(F.col("into").alias("_tg_part"), F.lit(-1).cast("long").alias("_tg_at"), F.to_json(F.struct(*_STATE)).alias("_tg_carry"))
        rows = rows.unionByName(starts, allowMissingColumns=True)  # a string: Spark hands rows with array columns to Python in time quadratic in a batch
    schema = T.StructType([*df.schema.fields, T.StructField("_tg_outcome", T.IntegerType())])
    rows = rows.repartition(n, "_tg_part").sortWithinPartitions("_tg_part", "_tg_at")
    out = written(rows.mapInArrow(_fold_calls(admit, to_arrow_schema(schema)), schema), "admission")
    outcome = F.col("_tg_outcome")
    return out.select(
        *own, (outcome == ACCEPTED).alias("accepted"),
        F.when(outcome == TOO_LARGE, E.RESOURCE_TOO_LARGE).when(outcome > TOO_LARGE, full_code).alias("error_code"))


def rate_limit(df: DataFrame, principal_col: str, ts_col: str, id_col: str, *,
               max_calls: int = RATE_LIMIT_CALLS, window_seconds: float = RATE_LIMIT_WINDOW_S) -> DataFrame:
    """Per principal, drop log entries with t <= now - window; reject when ``max_calls`` remain."""
    return sliding_admission(df, [principal_col], ts_col, id_col, limit=max_calls,
                             window_seconds=window_seconds, keep_equal_age=False, full_code=E.RATE_LIMIT_EXCEEDED)


def session_quota(df: DataFrame, principal_col: str, ts_col: str, id_col: str, *,
                  max_sessions: int = SESSIONS_PER_PRINCIPAL, ttl_seconds: float = SESSION_TTL_S) -> DataFrame:
    """Reject a session create when the principal already holds ``max_sessions`` live sessions
    (age <= ttl). Rejected creates hold no session. Null principals share one quota."""
    keyed = df.withColumn("_tg_pk", F.coalesce(F.col(principal_col).cast("string"), F.lit("\u0000")))
    out = sliding_admission(keyed, ["_tg_pk"], ts_col, id_col, limit=max_sessions,
                            window_seconds=ttl_seconds, keep_equal_age=True)
    return out.drop("_tg_pk")


def global_quota(df: DataFrame, ts_col: str, id_col: str, size_col: str, *,
                 max_sessions: int = MAX_SESSIONS, ttl_seconds: float = SESSION_TTL_S,
                 max_bytes: int = MAX_VAULT_BYTES) -> DataFrame:
    """One vault-wide sequence: at most ``max_sessions`` live sessions and ``max_bytes`` live bytes.

    The single global timeline is range-partitioned like any hot key, so its parts are folded in
    parallel and joined through their carry-in states.
    """
    return sliding_admission(df, [], ts_col, id_col, limit=max_sessions, window_seconds=ttl_seconds,
                             keep_equal_age=True, size_col=size_col, max_bytes=max_bytes)


def session_admission(df: DataFrame, principal_col: str, ts_col: str, id_col: str, size_col: str, *,
                      max_per_principal: int = SESSIONS_PER_PRINCIPAL, max_sessions: int = MAX_SESSIONS,
                      ttl_seconds: float = SESSION_TTL_S, max_bytes: int = MAX_VAULT_BYTES) -> DataFrame:
    """T8 and T9 as one decision per create: its own size, then its principal's live sessions, then all
    live sessions and bytes. A create that any rule rejects holds no session for the others."""
    return sliding_admission(df, [], ts_col, id_col, limit=max_sessions, window_seconds=ttl_seconds, keep_equal_age=True,
                             size_col=size_col, max_bytes=max_bytes, owner_col=principal_col, owner_limit=max_per_principal)

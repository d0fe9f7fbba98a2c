"""Registry of named queries: a Spark callable plus, where SQL can express it, an oracle SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from textguard.session import written

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


_HELD: list = []


def hold(result):
    """Remember a masking pass that persists; ``releasing`` drops it once the query's rows are written."""
    _HELD.append(result)
    return result


def releasing(fn: QueryFn) -> QueryFn:
    """The query's result is written to the shared folder, then the passes it persisted are released."""
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _HELD.clear()
        try:
            return written(fn(spark, sf_dir), fn.__name__)
        finally:
            while _HELD:
                _HELD.pop().release()
    return run


def load_all() -> None:
    """Import every plan module so their queries register."""
    from textguard.plans import (  # noqa: F401
        detection_queries, masking_queries, vault_queries, audit_queries, stream_queries, search_queries, text_queries,
    )

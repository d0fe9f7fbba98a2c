"""Validation predicates V1-V9 as row-level error columns (or driver-side checks for job parameters)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard import errors as E
from textguard.functions.patterns import (
    MAX_TERM_BYTES, MAX_TERMS, MAX_TEXT_BYTES, SECRET_POLICIES, STRATEGIES, SUPPORTED_LANGUAGES,
)

# Canonical lower-case UUID, version nibble 4, RFC 4122 variant nibble 8/9/a/b.
UUID4_RE = r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
PROJECT_RE = r"\A[A-Za-z0-9_-]+\z"
MAX_PROJECT_BYTES = 128
MAX_TOP_K = 50


def text_ok(text: Column, max_bytes: int = MAX_TEXT_BYTES) -> Column:
    """V1: present, non-empty, at most ``max_bytes`` UTF-8 bytes."""
    return F.coalesce(text.isNotNull() & (F.char_length(text) > 0) & (F.octet_length(text) <= max_bytes), F.lit(False))


def language_ok(lang: Column, languages: Sequence[str] = SUPPORTED_LANGUAGES) -> Column:
    """V2."""
    return F.coalesce(lang.isin(*languages), F.lit(False))


def options_ok(strategy: Column, on_secret: Column) -> Column:
    """V3 as a column check (when options vary per row)."""
    return F.coalesce(strategy.isin(*STRATEGIES) & on_secret.isin(*SECRET_POLICIES), F.lit(False))


def check_options(strategy: str, on_secret: str) -> None:
    """V3 for job parameters: fail fast on the driver."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if on_secret not in SECRET_POLICIES:
        raise ValueError(f"on_secret must be one of {SECRET_POLICIES}")


def terms_ok(terms: Column) -> Column:
    """V4 per row: null is allowed; else at most 50 terms of 1-100 UTF-8 bytes each."""
    good = (F.size(terms) <= MAX_TERMS) & F.forall(
        terms, lambda t: t.isNotNull() & (F.octet_length(t) >= 1) & (F.octet_length(t) <= MAX_TERM_BYTES))
    return terms.isNull() | F.coalesce(good, F.lit(False))


def dedupe_terms(terms: Column) -> Column:
    """Order-preserving de-duplication (first occurrence wins)."""
    return F.array_distinct(terms)


def check_terms(name: str, terms: Iterable[str] | None) -> tuple[str, ...]:
    """V4 for job parameters; returns the de-duplicated tuple."""
    if terms is None:
        return ()
    terms = list(terms)
    if len(terms) > MAX_TERMS:
        raise ValueError(f"{name}: {len(terms)} terms, limit {MAX_TERMS}")
    for t in terms:
        if not isinstance(t, str) or not t or len(t.encode("utf-8")) > MAX_TERM_BYTES:
            raise ValueError(f"{name}: a term is empty or longer than {MAX_TERM_BYTES} bytes")
    return tuple(dict.fromkeys(terms))


def session_id_ok(sid: Column) -> Column:
    """V5: 36 characters, canonical lower-case UUID version 4."""
    return F.coalesce(sid.rlike(UUID4_RE), F.lit(False))


def project_id_ok(pid: Column) -> Column:
    """V6: ``[A-Za-z0-9_-]+`` and at most 128 bytes."""
    return F.coalesce(pid.rlike(PROJECT_RE) & (F.octet_length(pid) <= MAX_PROJECT_BYTES), F.lit(False))


def top_k_ok(top_k: Column, dtype: T.DataType) -> Column:
    """V7: an integer 1-50. Booleans, strings and fractional types are refused by type."""
    if not isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.lit(False)
    return F.coalesce(top_k.between(1, MAX_TOP_K), F.lit(False))


def search_mode_ok(mode: Column) -> Column:
    return F.coalesce(mode.isin("vector", "hybrid"), F.lit(False))


def unknown_fields(json_text: Column, allowed: Sequence[str]) -> Column:
    """V9: keys of a JSON object request that are not in ``allowed`` (null if not an object)."""
    keys = F.map_keys(F.from_json(json_text, T.MapType(T.StringType(), T.StringType())))
    return F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))


def fields_ok(json_text: Column, allowed: Sequence[str]) -> Column:
    extra = unknown_fields(json_text, allowed)
    return F.coalesce(F.size(extra) == 0, F.lit(False))


def anonymize_request_error(text: Column, lang: Column) -> Column:
    return E.first_error((~text_ok(text), E.VALIDATION_ERROR), (~language_ok(lang), E.VALIDATION_ERROR))

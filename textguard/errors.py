"""Row-level error envelope.

A bad row never stops a job: it carries ``error = struct(code, message)`` and null
outputs. Messages are fixed strings and never contain input values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stable error codes of the reference, in its order, then the two
# envelope codes used for validation failures and unexpected failures.
SESSION_NOT_FOUND = "session_not_found"
PROHIBITED_SECRET = "prohibited_secret_detected"
SANDBOX_TIMEOUT = "sandbox_timeout"
UNSUPPORTED_LANGUAGE = "unsupported_language"
SANDBOX_IMAGE_INTEGRITY = "sandbox_image_integrity_error"
RESOURCE_TOO_LARGE = "resource_too_large"
PROJECT_NOT_AUTHORIZED = "project_not_authorized"
SESSION_NOT_AUTHORIZED = "session_not_authorized"
RATE_LIMIT_EXCEEDED = "rate_limit_exceeded"
SESSION_CAPACITY = "privacy_session_capacity_exhausted"
DOCKER_UNAVAILABLE = "docker_daemon_unavailable"
SANDBOX_EXECUTION = "sandbox_execution_error"
SANDBOX_CAPACITY = "sandbox_capacity_exhausted"
KNOWLEDGE_UNAVAILABLE = "knowledge_unavailable"
KNOWLEDGE_HYBRID_UNAVAILABLE = "knowledge_hybrid_unavailable"
CONCEPT_NOT_FOUND = "concept_not_found"
GATEWAY_ERROR = "gateway_error"
VALIDATION_ERROR = "validation_error"
INTERNAL_ERROR = "internal_error"

ALL_CODES = (
    SESSION_NOT_FOUND, PROHIBITED_SECRET, SANDBOX_TIMEOUT, UNSUPPORTED_LANGUAGE,
    SANDBOX_IMAGE_INTEGRITY, RESOURCE_TOO_LARGE, PROJECT_NOT_AUTHORIZED, SESSION_NOT_AUTHORIZED,
    RATE_LIMIT_EXCEEDED, SESSION_CAPACITY, DOCKER_UNAVAILABLE, SANDBOX_EXECUTION, SANDBOX_CAPACITY,
    KNOWLEDGE_UNAVAILABLE, KNOWLEDGE_HYBRID_UNAVAILABLE, CONCEPT_NOT_FOUND, GATEWAY_ERROR,
    VALIDATION_ERROR, INTERNAL_ERROR,
)

# One message per code, never containing input values; the validation and
# internal messages are deliberately generic.
MESSAGES = {
    SESSION_NOT_FOUND: "session is unknown or expired",
    PROHIBITED_SECRET: "prohibited secret detected",
    RESOURCE_TOO_LARGE: "resource exceeds size limit",
    PROJECT_NOT_AUTHORIZED: "project is not authorized",
    SESSION_NOT_AUTHORIZED: "session is not authorized",
    RATE_LIMIT_EXCEEDED: "request rate limit exceeded",
    SESSION_CAPACITY: "privacy session capacity exhausted",
    KNOWLEDGE_UNAVAILABLE: "knowledge base is unavailable",
    KNOWLEDGE_HYBRID_UNAVAILABLE: "full-text search is unavailable",
    CONCEPT_NOT_FOUND: "concept not found",
    VALIDATION_ERROR: "invalid input",
    INTERNAL_ERROR: "internal error",
}

ERROR_TYPE = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
])


def error(code: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(MESSAGES.get(code, code)).alias("message"))


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def first_error(*checks: tuple[Column, str]) -> Column:
    """Ordered ``when`` chain: the first failing check names the error (reference precedence)."""
    expr = None
    for cond, code in checks:
        expr = F.when(cond, error(code)) if expr is None else expr.when(cond, error(code))
    return no_error() if expr is None else expr.otherwise(no_error())


def split_errors(df: DataFrame, col: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    return df.filter(F.col(col).isNull()), df.filter(F.col(col).isNotNull())

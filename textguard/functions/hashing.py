"""Keyed hashing, session ids and the hash embedder, as column expressions.

Spark has no HMAC function. HMAC-SHA256(K, m) = SHA256((K ^ opad) || SHA256((K ^ ipad) || m))
is composed from ``sha2`` over binary concatenations. The pads are carried as binary
columns of a one-row key table (see ``operators.masking``), so the key never appears as
a literal in a query plan.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64  # SHA-256 block size in bytes


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\x00")
    ipad = bytes(b ^ 0x36 for b in key)
    opad = bytes(b ^ 0x5C for b in key)
    return ipad, opad


def key_table(spark: SparkSession, key: bytes | None = None) -> DataFrame:
    """One-row table ``(_tg_hk int, ipad binary, opad binary)``; random key when none is given."""
    ipad, opad = hmac_pads(key if key is not None else secrets.token_bytes(32))
    schema = T.StructType([
        T.StructField("_tg_hk", T.IntegerType(), False),
        T.StructField("_tg_ipad", T.BinaryType(), False),
        T.StructField("_tg_opad", T.BinaryType(), False),
    ])
    return spark.createDataFrame([(0, bytearray(ipad), bytearray(opad))], schema)


def uuid4_from_hex(h: Column) -> Column:
    """Format 32+ hex chars as a canonical lower-case UUID with version 4 and RFC variant."""
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, 1)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def with_token(df: DataFrame, run_token: str) -> DataFrame:
    """Add the run token as a column from a one-row table, so that it is no literal of the plan."""
    schema = T.StructType([T.StructField("_tg_tk", T.IntegerType(), False), T.StructField("_tg_token", T.StringType(), False)])
    tokens = df.sparkSession.createDataFrame([(0, run_token)], schema)
    return df.withColumn("_tg_tk", F.lit(0)).join(F.broadcast(tokens), "_tg_tk").drop("_tg_tk")  # one row


def session_id(*key_cols: Column) -> Column:
    """Deterministic v4-shaped id from the run token (column ``_tg_token``) and the row key.

    Recomputing a lost partition yields the same ids, so the masked output and the
    mapping table always agree.
    """
    parts = [F.col("_tg_token")] + [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in key_cols]
    return uuid4_from_hex(F.sha2(F.concat_ws("\u001f", *parts), 256))


def hash_embedding(text: Column, dims: int = 32) -> Column:
    """K1: SHA-256 of the UTF-8 text; component i = byte[i mod 32] / 255 * 2 - 1 (not semantic)."""
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    # The digest is the one element of an array: inside the inner function it is a variable, else it would be computed per component.
    return F.element_at(F.transform(F.array(digest), lambda h: F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: (F.conv(F.substring(h, (i % 32) * 2 + 1, 2), 16, 10).cast("double") / 255.0) * 2.0 - 1.0,
    )), 1)

"""No original value leaks into masked text, audit output, plan text or error messages."""
from datetime import datetime

from pyspark.sql import functions as F

SECRET_VALUES = ["max.mustermann@example.com", "AKIA" + "Q" * 16, "DE89370400440532013000", "sk-" + "z" * 24]
KEY = b"leak-test-key-material-0123456789"


def test_values_and_key_never_leak(spark):
    from textguard.operators import audit as A
    from textguard.operators.masking import anonymize
    rows = [(1, "Contact " + SECRET_VALUES[0] + " with key " + SECRET_VALUES[1]),
            (2, "IBAN " + SECRET_VALUES[2] + " token " + SECRET_VALUES[3]),
            (3, "x" * (100 * 1024 + 1) + SECRET_VALUES[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    for strategy in ("placeholder", "redact", "hash"):
        # iban_backoff: with the original rule an IBAN followed by words stays visible.
        a = anonymize(df, "text", strategy=strategy, hash_key=KEY, key_cols=["id"], keep_entities=True, iban_backoff=True)
        masked = a.masked.select("id", "anonymized_text", "error").collect()
        blob = " ".join(str(r.anonymized_text) + " " + str(r.error) for r in masked)
        for v in SECRET_VALUES:
            assert v not in blob, (strategy, v)
        plan = a.masked._jdf.queryExecution().toString()
        assert KEY.hex() not in plan and KEY.decode() not in plan
        for v in SECRET_VALUES:
            assert v not in plan
        snap = A.to_json_text(A.snapshot(a.masked, None, a.mapping, as_of=datetime(2024, 1, 1))).first().json
        for v in SECRET_VALUES:
            assert v not in snap
    blocked = anonymize(df, "text", on_secret="block", key_cols=["id"]).masked.select("error").collect()
    for r in blocked:
        assert r.error is None or all(v not in r.error.message for v in SECRET_VALUES)


def test_iban_followed_by_words_parity_and_backoff(masker):
    # (A space right after the check digits never matches the rule at all, grouped or not.)
    text = "IBAN DE89370400440532013000 token here; FR7630006000011234567890189 ok"
    (r,), _ = masker([text])
    assert "DE89370400440532013000" in r.anonymized_text  # parity: greedy candidate fails the length check
    (r,), _ = masker([text], iban_backoff=True)
    assert r.anonymized_text == "IBAN <IBAN_CODE_0> token here; <IBAN_CODE_1> ok"


def test_limits_store_no_texts_and_no_values(spark):
    """What the folds of rate limit and session caps write holds neither texts nor mapped values."""
    import os

    from textguard.operators.limits import anonymize_calls
    from textguard.session import checkpoint_dir
    base = checkpoint_dir(spark)
    before = set(os.listdir(base))
    calls = spark.createDataFrame([(k, f"mail u{k}@secret.example", "ann" if k % 2 else "bob", k) for k in range(8)], "id long, text string, who string, at long")
    out = anonymize_calls(calls.withColumn("ts", F.timestamp_seconds("at")), "text", id_col="id", principal_col="who", ts_col="ts", max_calls=3, max_per_principal=2)
    codes = {r["id"]: r["error"] and r["error"]["code"] for r in out.masked.collect()}
    assert list(codes.values()).count("rate_limit_exceeded") == 2 and list(codes.values()).count("privacy_session_capacity_exhausted") == 2
    assert {r["id"] for r in out.mapping.collect()} == {k for k, c in codes.items() if c is None}
    written = 0
    for folder in set(os.listdir(base)) - before:
        for root, _, files in os.walk(os.path.join(base, folder)):
            for name in files:
                if name.endswith(".parquet"):
                    written += 1
                    for r in spark.read.parquet(os.path.join(root, name)).collect():
                        assert "secret.example" not in str(r)
    assert written
    out.release()

"""What a query keeps of its masking pass stays out of the executors' memory, and its rows stay right."""
import json

import pytest

TEXTS = ["mail ann@example.com and B-AB 12", "nothing here", "x@y.de, x@y.de", "key " + "AKIA" + "Q" * 16, None, "B-AB 12 x@y.de"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("kept"))
    rows = [(k, TEXTS[k % 6], "de" if k % 2 else "en", "web", 0) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    return base


@pytest.fixture
def run(spark, sf_dir, monkeypatch):
    """Rows of a query, and (storage level, columns) of everything that it kept."""
    import __spark_entry__ as entry

    kind, kept = type(spark.range(0)), []
    persist = kind.persist

    def recorded(self, *level):
        kept.append((level[0] if level else None, self.columns))
        return persist(self, *level)

    monkeypatch.setattr(kind, "persist", recorded)
    return lambda name: ([r.asDict() for r in entry.queries()[name](spark, sf_dir).collect()], kept)


def on_disk(kept):
    return [level is not None and level.useDisk and not level.useMemory for level, _ in kept] == [True]


def test_one_consumer_keeps_nothing_by_type(run):
    rows, kept = run("audit_by_type")
    assert {r["etype"]: r["n"] for r in rows} == {"EMAIL_ADDRESS": 8, "GERMAN_LICENSE_PLATE": 4, "AWS_KEY": 2}
    assert kept == []


def test_one_consumer_keeps_nothing_by_lang(run):
    rows, kept = run("audit_by_lang")
    assert {r["lang"]: (r["total_anonymizations"], r["total_pii_entities"]) for r in rows} == {"en": (4, 8), "de": (6, 6)}
    assert kept == []


def test_public_projection_keeps_counts_only(run):
    rows, kept = run("audit_public_projection")
    stats = {r["lang"]: json.loads(r["public_json"]) for r in rows}
    assert stats["en"] == {"total_anonymizations": 4, "total_pii_entities": 8, "entities_by_type": {"EMAIL_ADDRESS": 6, "GERMAN_LICENSE_PLATE": 2}}
    assert stats["de"] == {"total_anonymizations": 6, "total_pii_entities": 6, "entities_by_type": {"AWS_KEY": 2, "EMAIL_ADDRESS": 2, "GERMAN_LICENSE_PLATE": 2}}
    assert on_disk(kept) and not {"text", "anonymized_text", "_tg_ents", "_tg_map"} & set(kept[0][1])


def test_totals_pass_is_on_disk(run):
    rows, kept = run("audit_totals")
    assert rows == [{"total_anonymizations": 10, "total_pii_entities": 14, "total_deanonymizations": 4, "failed_deanonymizations": 4}]
    assert on_disk(kept)


def test_snapshot_pass_is_on_disk(run):
    rows, kept = run("audit_json")
    snap = json.loads(rows[0]["json"])
    assert snap["entities_by_type"] == {"AWS_KEY": 2, "EMAIL_ADDRESS": 8, "GERMAN_LICENSE_PLATE": 4}
    assert (snap["total_deanonymizations"], snap["failed_deanonymizations"], snap["active_sessions"]) == (4, 4, 8)
    assert on_disk(kept)


def test_roundtrip_pass_is_on_disk(run):
    rows, kept = run("roundtrip")
    assert {r["doc_id"]: r["restored_text"] for r in rows} == {k: TEXTS[k % 6] for k in range(12) if k % 6 not in (1, 4)}
    assert on_disk(kept)


@pytest.mark.parametrize("name", ["restore_errors", "restore_stream"])
def test_restore_pass_is_on_disk(run, name):
    rows, kept = run(name)
    code = {1: "session_not_authorized", 3: "session_not_found", 4: "session_not_found", 5: "session_not_found"}
    expected = {k: (k % 6, code.get(k % 6), TEXTS[k % 6] if k % 6 in (0, 2) else None) for k in range(12) if k % 6 not in (1, 4)}
    assert {r["doc_id"]: (r["kind"], r["error_code"], r["restored_text"]) for r in rows} == expected and len(rows) == 8
    assert on_disk(kept)


def test_restore_cap_pass_is_on_disk(run):
    rows, kept = run("restore_cap")
    size = {0: 4000 * 16, 2: 4000 * 7, 3: 72_000, 5: 4000 * 7}
    assert {r["doc_id"]: (r["error_code"], r["restored_bytes"]) for r in rows} == {k: (None, size[k % 6]) for k in range(12) if k % 6 in size}
    assert on_disk(kept)


def test_limited_calls_pass_is_on_disk_and_masks_once(run, monkeypatch):
    from textguard.operators import masking

    counted = []
    monkeypatch.setattr(masking, "spread", lambda df: counted.append(df) or df)
    rows, kept = run("limited_calls")
    assert len(rows) == 12 and [r["doc_id"] for r in rows if r["plain_md5"]] and all(r["error_code"] or r["has_session"] or TEXTS[r["doc_id"] % 6] in (None, TEXTS[1]) for r in rows)
    assert on_disk(kept)
    assert not counted  # counting the partitions of the joined calls runs their shuffle once more

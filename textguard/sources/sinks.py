"""Sinks for masked text (S4) and mapping rows."""

from __future__ import annotations

from textguard.operators.masking import Anonymized


def write_masked(result: Anonymized, path: str, *, mapping_path: str | None = None, fmt: str = "parquet",
                 mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write the masked rows; write the mapping rows only when ``mapping_path`` is given.

    The mapping holds original values; it is never written implicitly. Use an encrypted
    location (and ``spark.io.encryption.enabled`` for shuffle/spill files) when it is.
    """
    w = result.masked.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    if mapping_path is not None:
        result.mapping.write.format(fmt).mode(mode).save(mapping_path)

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from textguard.session import checkpoint_dir, get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    checkpoint_dir(s)  # tests set their own shared folder only because none is configured
    yield s


@pytest.fixture(scope="session")
def masker(spark):
    """Mask a list of strings with given options; returns list of Row."""
    from textguard.operators.masking import anonymize

    def run(texts, **kw):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
        kw.setdefault("key_cols", ["id"])
        out = anonymize(df, "text", keep_entities=True, **kw)
        return sorted(out.masked.collect(), key=lambda r: r.id), out
    return run

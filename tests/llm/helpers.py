"""Small tables with everything an operator must survive: nulls, empty and long texts, repeats, clashing names."""

CLASHES = ("id", "host", "h", "w", "s", "rep", "bucket", "label", "score", "shard", "prefix", "row", "kind", "toxic", "held_out", "item", "doc", "measured")


def prose(seed: int, words: int) -> str:
    out, x = [], seed * 2654435761 % 2**32 or 1
    for _ in range(words):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("w%d" % (x >> 8 & 1023))
    return " ".join(out)


LONG_TEXT = prose(99, 30_000)
MESSY = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, LONG_TEXT), (6, "x" * 100_000), (7, prose(7, 60)), (7, prose(7, 60)),
    (8, prose(7, 60)), (9, prose(7, 60).upper()), (None, prose(7, 60)), (None, None), (10, "é ü #<b> $ | ñ\u00a0x\u2003y"),
]


def messy(spark, rows=MESSY, name="doc_id", text="text"):
    df = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], f"{name} long, {text} string, " + ", ".join(f"{c} int" for c in CLASHES))
    return df.repartition(3)


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))

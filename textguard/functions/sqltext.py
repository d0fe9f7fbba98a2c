"""Spark SQL text for the higher-order-function expressions of the span engine.

Building these trees through the Column API costs one JVM round trip per node (tens of
thousands per pipeline); parsing one SQL text per column gives the same expression in
a single call. Column names are back-quoted; string literals go through ``sql_str``.
"""

from __future__ import annotations

from textguard.functions.patterns import IBAN_LENGTHS, SECRET_TYPES

SPAN_DDL = "struct<`etype`:string,`value`:string,`start`:int,`end`:int,`ord`:int>"
SPANS_DDL = f"array<{SPAN_DDL}>"


def sql_str(s: str) -> str:
    """A Spark SQL string literal whose value is exactly ``s`` (backslashes survive unescaping)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def q(col: str) -> str:
    return "`" + col.replace("`", "``") + "`"


EMPTY_SPANS = f"CAST(array() AS {SPANS_DDL})"
IBAN_MAP = "map(" + ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items()) + ")"
SECRETS_IN = "(" + ", ".join(f"'{t}'" for t in SECRET_TYPES) + ")"


def normalized(x: str) -> str:
    return f"regexp_replace({x}, {sql_str(r'[ .\-]')}, '')"


def valid_iban(x: str) -> str:
    c = f"upper(regexp_replace({x}, {sql_str(r'[ \-]')}, ''))"
    shape = f"({c} rlike {sql_str(r'(?U)^[A-Z]{2}\d{2}[A-Z0-9]+$')})"
    length_ok = f"(char_length({c}) = try_element_at({IBAN_MAP}, substring({c}, 1, 2)))"
    moved = f"concat(substring({c}, 5), substring({c}, 1, 4))"
    mod = (f"aggregate(split({moved}, ''), 0, (acc, ch) -> CASE WHEN ch rlike '^[A-Z]$' "
           f"THEN (acc * 100 + (ascii(ch) - 55)) % 97 ELSE (acc * 10 + try_cast(ch AS INT)) % 97 END)")
    return f"coalesce({shape} AND {length_ok} AND {mod} = 1, false)"


def valid_tax_id(x: str) -> str:
    d = f"split({x}, '')"
    fold = (f"aggregate(slice({d}, 1, 10), 10, (p, ch) -> (2 * CASE WHEN (try_cast(ch AS INT) + p) % 10 = 0 THEN 10 "
            f"ELSE (try_cast(ch AS INT) + p) % 10 END) % 11)")
    return (f"coalesce(char_length({x}) = 11 AND {x} rlike '^[0-9]{{11}}$' AND size(array_distinct({d})) > 1 "
            f"AND (11 - {fold}) % 10 = try_cast(substring({x}, 11, 1) AS INT), false)")


def phone_digits_ok(x: str) -> str:
    return f"(char_length(regexp_replace({x}, {sql_str(r'(?U)\D')}, '')) BETWEEN 8 AND 15)"


def iban_cut(x: str) -> str:
    """The candidate cut after its country's number of characters (separators kept)."""
    n = f"try_element_at({IBAN_MAP}, upper(substring({x}, 1, 2)))"
    return f"regexp_extract({x}, concat('^(?:[A-Za-z0-9][ -]?){{', CAST({n} - 1 AS STRING), '}}[A-Za-z0-9]'), 0)"


def iban_backoff_ok(x: str) -> str:
    """Opt-in retry for a greedy candidate that failed: the country-length cut must end at a
    token boundary and pass the checksum."""
    c = iban_cut(x)
    return (f"coalesce(char_length({c}) > 0 AND NOT (substring({x}, char_length({c}) + 1, 1) rlike '[A-Za-z0-9]') "
            f"AND {valid_iban(normalized(c))}, false)")


def check(kind: str | None, x: str) -> str | None:
    if kind is None:
        return None
    if kind == "iban":
        return valid_iban(normalized(x))
    if kind == "tax_id":
        return valid_tax_id(normalized(x))
    if kind == "phone_digits":
        return phone_digits_ok(x)
    raise ValueError(kind)


def prefix_sums(arr: str) -> str:
    """Inclusive prefix sums in ceil(log2 n) passes (Hillis-Steele); ``arr`` should be a column."""
    return (f"aggregate(filter(transform(sequence(0, 30), j -> CAST(pow(2, j) AS INT)), k -> k < size({arr})), {arr}, "
            f"(acc, k) -> transform(acc, (x, i) -> x + IF(i >= k, acc[i - k], 0)))")


def steps(vals: str, gaps: str) -> str:
    return f"zip_with({vals}, slice({gaps}, 1, size({vals})), (mv, mg) -> char_length(mg) + char_length(mv))"


def spans_from(vals: str, steps_col: str, etype: str, ord_: int) -> str:
    return (f"zip_with({vals}, {prefix_sums(steps_col)}, (mv, me) -> named_struct('etype', {sql_str(etype)}, "
            f"'value', mv, 'start', me - char_length(mv), 'end', me, 'ord', {int(ord_)}))")


def literal_spans(gaps: str, term: str, etype: str, ord_: int) -> str:
    n = len(term)
    st = f"transform(slice({gaps}, 1, size({gaps}) - 1), mg -> char_length(mg) + {n})"
    return (f"transform({prefix_sums(st)}, me -> named_struct('etype', {sql_str(etype)}, 'value', {sql_str(term)}, "
            f"'start', me - {n}, 'end', me, 'ord', {int(ord_)}))")


OVERLAP = "(a.`start` < b.`end` AND b.`start` < a.`end`)"
BY_START = ("(a, b) -> CASE WHEN a.`start` < b.`start` THEN -1 WHEN a.`start` > b.`start` THEN 1 "
            "WHEN a.`ord` < b.`ord` THEN -1 WHEN a.`ord` > b.`ord` THEN 1 ELSE 0 END")
PRIORITY = ("(a, b) -> CASE WHEN a.`end` - a.`start` > b.`end` - b.`start` THEN -1 "
            "WHEN a.`end` - a.`start` < b.`end` - b.`start` THEN 1 "
            "WHEN a.`start` < b.`start` THEN -1 WHEN a.`start` > b.`start` THEN 1 "
            "WHEN a.`ord` < b.`ord` THEN -1 WHEN a.`ord` > b.`ord` THEN 1 ELSE 0 END")


def overlaps_any(s: str, others: str) -> str:
    return f"exists({others}, o -> {s}.`start` < o.`end` AND o.`start` < {s}.`end`)"


def sort_by_start(spans: str) -> str:
    return f"array_sort({spans}, {BY_START})"


def no_overlaps(sorted_col: str) -> str:
    return (f"forall(sequence(1, greatest(size({sorted_col}) - 1, 1)), "
            f"i -> i >= size({sorted_col}) OR {sorted_col}[i - 1].`end` <= {sorted_col}[i].`start`)")


def greedy(spans: str) -> str:
    return (f"array_sort(aggregate(array_sort({spans}, {PRIORITY}), {EMPTY_SPANS}, "
            f"(kept, s) -> IF({overlaps_any('s', 'kept')}, kept, concat(kept, array(s)))), {BY_START})")


def is_secret(s: str) -> str:
    return f"{s}.`etype` IN {SECRETS_IN}"

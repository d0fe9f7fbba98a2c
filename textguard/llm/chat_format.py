"""Chat formatting: a declarative template, a finite-state machine over roles, loss flags per segment.

A turn becomes three segments: header, body, end mark. Only bodies of the template's loss roles
carry the loss flag. Characters that a control string needs (``#``, ``<``, the escape sign, and in
roles ``:``) are written as two-character escapes inside roles and texts, so control strings never
occur there and the formatted text can be parsed back exactly.

Defined results: a null role or text counts as empty; turns are ordered by (turn, role, text), nulls
first, and repeated rows stay as repeated turns; rows without a conversation id form one conversation
of their own; an unknown role is formatted as it is and makes the conversation invalid; an empty table
gives no rows; other input columns are not carried along.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``header`` holds the role between its two parts; ``moves`` lists the allowed role changes."""

    header: tuple[str, str] = ("### ", ": ")
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str], ...] = (
        ("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    )
    accept: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = field(default=(("<", "\\l"), ("#", "\\h"), (":", "\\c")))

    def escape(self, text: Column, role: bool = False) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for sign, code in self.escapes:
            if role or sign != ":":
                out = F.replace(out, F.lit(sign), F.lit(code))
        return out

    def unescape(self, text: Column) -> Column:
        """Pairs of escape signs are split off first, so a code after one is not misread."""
        def codes(part: Column) -> Column:
            for sign, code in self.escapes:
                part = F.replace(part, F.lit(code), F.lit(sign))
            return part

        return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def _machine(turns: Column, template: Template) -> Column:
    """Final state and 0-based place of the first turn out of order (null if there is none)."""
    moves = F.create_map(*[F.lit(x) for a, b in template.moves for x in (f"{a}>{b}", b)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        state = F.coalesce(F.element_at(moves, F.concat(acc["state"], F.lit(">"), turn["role"])), F.lit("error"))
        bad = F.coalesce(acc["bad"], F.when(state == "error", acc["at"]))
        return F.struct(state.alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(turns, start, step)


def format_conversations(rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv id, formatted, segments array<struct<text, loss>>, valid, bad_turn.

    A conversation is one training example, so its turns meet in one row; roles and texts are escaped
    before the shuffle, row by row.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("raw"),
                    template.escape(role, role=True).alias("erole"), template.escape(text).alias("body"))
    grouped = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.header[0]), t["erole"], F.lit(template.header[1]))
        parts = ((head, F.lit(False)), (t["body"], t["role"].isin(*template.loss_roles)), (F.lit(template.end), F.lit(False)))
        return F.array(*[F.struct(x.alias("text"), loss.alias("loss")) for x, loss in parts])

    out = grouped.select("conv", F.flatten(F.transform("turns", segments)).alias("segments"), _machine(F.col("turns"), template).alias("m"))
    return out.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("m.bad").isNull() & F.col("m.state").isin(*template.accept)).alias("valid"),
        F.col("m.bad").alias("bad_turn"),
    )


def parse_formatted(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted text alone."""
    def turn(piece: Column) -> Column:
        at = F.instr(piece, template.header[1])
        start = len(template.header[0]) + 1
        role = F.substr(piece, F.lit(start), at - F.lit(start))
        return F.struct(template.unescape(role).alias("role"), template.unescape(F.substr(piece, at + F.lit(len(template.header[1])))).alias("text"))

    pieces = F.split(formatted, "\\Q" + template.end + "\\E")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")

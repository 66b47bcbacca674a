r"""Chat formatting by a finite-state machine over roles (operator 6, native).

A template declares the states' transitions, the marks around a turn and which roles and
marks are trained on. ``machine`` runs it over the turns of each conversation in order (the
state after a turn is its role, or an absorbing error), ``segments`` emits the text pieces
with a loss flag each, and ``conversations`` gathers them, one row per conversation.

Control strings inside texts are escaped: a ``<``, any backslashes and a ``|`` get one backslash
more, so no ``<|`` is left; ``unescaped`` takes it away again. In roles, backslashes become ``\b`` and line
breaks ``\n`` before that.

Null text or role: the empty string (an unknown role, so an error state). Rows of a conversation go
by turn, nulls first, then role and text; repeated rows are turns of their own. A null
conversation id is one conversation. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, ERROR = "", "!"


@dataclass(frozen=True)
class Template:
    """ChatML by default. ``transitions`` maps a state to the roles that may follow it."""

    transitions: dict[str, list[str]] = field(default_factory=lambda: {START: ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]})
    accepting: tuple[str, ...] = ("user", "assistant")
    turn_open: str = "<|im_start|>"
    role_close: str = "\n"
    turn_close: str = "<|im_end|>"
    turn_gap: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    loss_on_close: bool = False


CHATML = Template()


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    # Every backslash left is followed by b or n, so the two replacements can't meet.
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls as empty strings."""
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def machine(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """Turns with their ``ordinal`` (from 1), the ``state`` before, ``legal`` and ``state_after``.

    A turn is legal if its state allows its role and all turns before were legal. The window
    streams through a conversation of any length.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    allowed = F.from_json(F.lit(json.dumps(template.transitions)), "map<string,array<string>>")
    rows = turns(df).withColumn("ordinal", F.row_number().over(order)).withColumn("_before", F.coalesce(F.lag("role").over(order), F.lit(START)))
    rows = rows.withColumn("_step", F.coalesce(F.array_contains(F.element_at(allowed, F.col("_before")), F.col("role")), F.lit(False)) & ((F.col("ordinal") == 1) | (F.col("_before") != START)))
    rows = rows.withColumn("legal", F.min("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("state_after", F.when(F.col("legal"), F.col("role")).otherwise(F.lit(ERROR)))
    return rows.withColumn("state", F.coalesce(F.lag("state_after").over(order), F.lit(START))).drop("_before", "_step")


def turn_segments(template: Template) -> Column:
    """The pieces of one turn: array of (text, loss)."""
    trained = F.col("role").isin(*template.loss_roles)
    return F.array(
        F.struct(F.concat(F.lit(template.turn_open), escaped_role(F.col("role")), F.lit(template.role_close)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(F.col("text")).alias("text"), trained.alias("loss")),
        F.struct(F.lit(template.turn_close).alias("text"), (trained & F.lit(template.loss_on_close)).alias("loss")),
        F.struct(F.lit(template.turn_gap).alias("text"), F.lit(False).alias("loss")),
    )


def segments(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per piece: conv_id, ordinal of its turn, piece, text, loss, legal."""
    rows = machine(df, template).select("conv_id", "ordinal", "legal", F.posexplode(turn_segments(template)).alias("piece", "s"))
    return rows.select("conv_id", "ordinal", "piece", F.col("s.text").alias("text"), F.col("s.loss").alias("loss"), "legal")


def loss_mask(segments: Column) -> Column:
    """array<struct<offset, length>> of a turn's trained pieces: characters from the turn's first one, its opening mark."""
    before = lambda i: F.aggregate(F.slice(segments, F.lit(1), i), F.lit(0), lambda n, s: n + F.length(s["text"]))
    spans = F.transform(segments, lambda s, i: F.struct(before(i).alias("offset"), F.length(s["text"]).alias("length"), s["loss"].alias("loss")))
    return F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["offset"].alias("offset"), s["length"].alias("length")))


def conversations(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: its segments in order, ``formatted`` (their texts joined), ``loss_mask`` (of each turn the spans of
    ``formatted`` to train on, counted from the turn's start), ``valid`` and ``first_illegal``.

    A conversation is one training example and so must fit a row; only its own turns are gathered.
    """
    rows = machine(df, template).withColumn("segments", turn_segments(template)).withColumn("mask", loss_mask(F.col("segments")))
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "segments", "mask"))).alias("_turns"),
        F.min("legal").alias("_legal"),
        F.max_by("state_after", "ordinal").alias("final_state"),
        F.min(F.when(~F.col("legal"), F.col("ordinal"))).alias("first_illegal"),
    )
    pieces = F.flatten(F.transform("_turns", lambda t: t["segments"]))
    mask = F.transform("_turns", lambda t: t["mask"])
    out = grouped.select("conv_id", pieces.alias("segments"), mask.alias("loss_mask"), (F.col("_legal") & F.col("final_state").isin(*template.accepting)).alias("valid"), "final_state", "first_illegal")
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """Rows of ``conversations`` with ``turns_read`` (array of role, text) parsed from ``formatted``, and ``loss_read``: what
    ``formatted`` holds under ``loss_mask``, unescaped."""
    # Control strings inside texts are escaped, so the opening mark parts turns; what precedes the first is empty.
    parts = F.slice(F.split("formatted", _quoted(template.turn_open)), 2, 1 << 30)
    close, opened = template.turn_close + template.turn_gap, len(template.turn_open)

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - len(close))
        cut = F.instr(body, template.role_close)
        return F.struct(unescaped_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(body, cut + len(template.role_close), F.length(body))).alias("text"))

    def trained(part: Column, spans: Column) -> Column:
        return F.transform(spans, lambda s: unescaped(F.substring(part, s["offset"] - opened + 1, s["length"])))

    return df.withColumn("turns_read", F.transform(parts, turn)).withColumn("loss_read", F.flatten(F.zip_with(parts, F.col("loss_mask"), trained)))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() and c != "_" else c for c in text)

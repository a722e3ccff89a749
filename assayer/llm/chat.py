"""Chat formatting: a finite-state machine over roles and a declarative template, in column expressions.

Turns are ordered by ``turn`` (then role and text, so ties and repeated rows have a fixed place); null turns come
first.  A null role or text counts as empty.  Control strings inside texts are escaped, so the formatted text can
be split back exactly.  A conversation whose roles the machine does not accept is formatted all the same and marked
``valid = false``; ``bad_turn`` is the place (from 0) of the first turn that does not fit.  Rows with a null
``conv_id`` form one conversation.  One conversation is one text and so one row; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which role may follow which, and whose texts are learned."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
        }
    )
    learned: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    """Double every backslash, then break ``<|`` with a single one, which nothing else leaves behind ``<``."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a line end would also end the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, bad_turn, segments, formatted``.

    ``segments`` are the pieces of ``formatted`` in order, each with a flag that says whether it is learned.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        ).alias("turn_row"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn_row")).alias("turn_rows"))
    accepted = [F.lit(f"{a}\n{b}") for a, then in template.moves.items() for b in then]

    def step(state: Column, turn: Column) -> Column:
        fits = state["fits"] & F.array_contains(F.array(*accepted), F.concat(state["role"], F.lit("\n"), turn["role"]))
        return F.struct(turn["role"].alias("role"), fits.alias("fits"), (state["n"] + fits.cast("int")).alias("n"))

    start = F.struct(F.lit("").alias("role"), F.lit(True).alias("fits"), F.lit(0).alias("n"))

    def pieces(turn: Column) -> Column:
        plain = F.lit(False).alias("loss")
        return F.array(
            F.struct(F.concat(F.lit(template.start), escape_role(turn["role"]), F.lit(template.after_role)).alias("text"), plain),
            F.struct(escape(turn["text"]).alias("text"), turn["role"].isin(*template.learned).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), plain),
        )

    return chats.select(
        "conv_id",
        F.size("turn_rows").cast("long").alias("n_turns"),
        F.aggregate("turn_rows", start, step).alias("run"),
        F.flatten(F.transform("turn_rows", pieces)).alias("segments"),
    ).select(
        "conv_id", "n_turns", F.col("run.fits").alias("valid"),
        F.when(~F.col("run.fits"), F.col("run.n")).alias("bad_turn"),
        "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, as an array of ``role, text``."""
    parts = F.split(formatted, "\\Q" + template.end + "\\E", -1)

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(template.start) + 1), F.length(part))
        role = F.substring_index(body, template.after_role, 1)
        text = F.substring(body, F.length(role) + F.lit(len(template.after_role) + 1), F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def digest(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """The digests of what the formatted text gives back, and of all text under the loss mask."""
    back = chats.select(
        "conv_id", "valid", "formatted", read_back(F.col("formatted"), template).alias("back"),
        F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))).alias("learned"),
    )
    lines = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )



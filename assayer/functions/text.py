"""Scalar expressions on item text, names and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.common import let

# fixed values: element symbols accepted in a library and in the 3-D step
LIBRARY_SYMBOLS = ["C", "H", "O", "N", "S", "P", "F", "Cl", "Br", "I"]
STEP_3D_SYMBOLS = ["C", "H", "O", "N", "S", "P", "F", "Cl", "Br", "I", "B", "Si"]
# fixed value: markers a converted structure must hold
REQUIRED_MARKERS = ["ROOT", "TORSDOF"]
NO_REASON = "no reason given"


def valid_format(item: Column) -> Column:
    """At least two characters and at most one dot."""
    dots = F.length(item) - F.length(F.replace(item, F.lit("."), F.lit("")))
    return F.coalesce((F.length(item) >= 2) & (dots <= 1), F.lit(False))


def offending_tokens(item: Column, pattern: str, allowed: Sequence[str]) -> Column:
    """Distinct tokens of the pattern outside the allowed set, sorted."""
    tokens = F.regexp_extract_all(item, F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_except(tokens, F.array(*[F.lit(a) for a in allowed])))


def largest_fragment(item: Column, sep: str = r"\.") -> Column:
    """The longest part between separators; the first of equally long ones."""
    def pick(parts: Column) -> Column:
        # longest first, then by place: a struct compares field by field
        sized = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("place"), p.alias("part")))
        return F.array_max(sized).getField("part")
    return let(F.split(item, sep), pick)


def first_number(tag_value: Column) -> Column:
    """First number of a tag value, up to a ``$$``; NULL when there is none."""
    head = F.substring_index(tag_value, "$$", 1)
    return F.regexp_extract(head, r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0).try_cast("double")


def tag_value(block: Column, tag: str) -> Column:
    """The line under ``> <tag>`` (quotes and inner spaces allowed, any case); NULL when absent."""
    found = F.regexp_extract(block, rf"(?i)>\s*<\s*'?{tag}'?\s*>\s*\n([^\n\r$]+)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def model_of_file(name: Column) -> Column:
    """Model label: the file stem up to the first underscore."""
    return F.regexp_extract(name, r"([^/_]+)[^/]*$", 1)


def round_of_file(name: Column) -> Column:
    """Round number: the digits after the last underscore of the stem."""
    return F.regexp_extract(name, r"_(\d+)\.[^./]*$", 1).try_cast("int")


def base26_id(index: Column) -> Column:
    """0 -> KAA, 1 -> KAB, ... 675 -> KZZ; beyond that K and the leading digits."""
    def letter(i):
        return F.chr((65 + i).cast("int"))
    beyond = F.substring(F.concat(F.lit("K"), index.cast("string")), 1, 3)
    return F.when(
        index < 676, F.concat(F.lit("K"), letter(F.floor(index / 26)), letter(F.pmod(index, F.lit(26))))
    ).otherwise(beyond)


def tidy_reason(reason: Column) -> Column:
    """Reasons with commas instead of semicolons, or the default text."""
    return F.coalesce(F.replace(reason, F.lit(";"), F.lit(", ")), F.lit(NO_REASON))


def reason_preview(reason: Column, width: int = 100) -> Column:
    """A display preview of a long reason; the whole reason stays in its own column."""
    text = F.coalesce(reason, F.lit(NO_REASON))
    short = F.concat(F.substring(text, 1, width), F.lit(" [cut]"))
    return F.when(F.length(text) > width, short).otherwise(text)


def default_name(name: Column, other: Column, number: Column) -> Column:
    """The name, else the alternative, else ``mol_{number}``; blanks count as missing."""
    return F.coalesce(
        F.nullif(F.trim(name), F.lit("")),
        F.nullif(F.trim(other), F.lit("")),
        F.concat(F.lit("mol_"), number.cast("string")),
    )


def missing_markers(content: Column, markers: Sequence[str] = tuple(REQUIRED_MARKERS)) -> Column:
    """Markers the content lacks; all of them when it is empty or NULL."""
    text = F.coalesce(content, F.lit(""))
    absent = [F.when(~F.contains(text, F.lit(m)), F.lit(m)) for m in markers]
    return F.filter(F.array(*absent), lambda m: m.isNotNull())


def text_descriptors(item: Column) -> dict[str, Column]:
    """Built-in descriptors of a text item (size, words, digit share, mean word length)."""
    words = F.size(F.filter(F.split(item, r"[ \t\r\n]+"), lambda w: w != ""))
    letters = F.length(F.regexp_replace(item, r"[ \t\r\n]", ""))
    digits = F.length(F.regexp_replace(item, r"[^0-9]", ""))
    return {
        "n_chars": F.length(item).cast("double"),
        "n_words": words.cast("double"),
        "digit_share": F.try_divide(digits.cast("double"), F.length(item)),
        "word_length": F.try_divide(letters.cast("double"), words),
    }

"""Fill-in-middle transformation over an indexable skip list of each text's tokens.

A token is a run of ASCII white space (space, 0x09 to 0x0D) with the run of other characters behind it, or white space
at the end of the text.  A skip list holds the boundaries of the tokens: every link of every lane carries how many
tokens and how many code points it crosses, and a descent that adds up these widths arrives at a cut rank and its
code-point offset together, in about four steps a lane.

Null text counts as empty and stays plain.  Rows are independent: a repeated ``doc_id`` gives repeated rows with the same
draw, and a null one draws from the seed alone.  Texts of any length are handled whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import id_and_text, slices
from assayer.llm.shingles import mix

# fixed values: the marks of the three parts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def token_widths(text: str) -> np.ndarray:
    """The code points of every token of ``text``, in order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.diff(np.concatenate([[0], starts, [len(points)]])).astype(np.int64)


class SkipList:
    """Token boundaries under express lanes; a boundary rises one lane further with a chance of one in four.

    Heights are a hash of the boundary's place, so a list is the same whenever it is built.
    """

    def __init__(self, widths: np.ndarray) -> None:
        offsets = np.concatenate([[0], np.cumsum(widths)])
        place = np.arange(len(offsets))
        draw = mix(place.astype(np.uint64) + np.uint64(1))
        #: from the base up: code points and tokens that each link crosses, and where its first boundary stands one lane below
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        down = place
        while True:
            self.lanes.append((np.diff(place), np.diff(offsets[place]), down))
            if len(place) == 1:
                break
            rises = (draw & np.uint64(3)) == 0
            rises[0] = True  # the head stands in every lane
            down = np.flatnonzero(rises)
            place, draw = place[down], draw[down] >> np.uint64(2)

    def offset(self, rank: int) -> int:
        """Code points before the token of this rank."""
        crossed = points = at = 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            units, widths, down = self.lanes[lane]
            while at < len(units) and crossed + units[at] <= rank:
                crossed += int(units[at])
                points += int(widths[at])
                at += 1
            at = int(down[at])
        if crossed != rank:
            raise IndexError(f"rank {rank} lies beyond the last token")
        return points


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the document alone."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(doc_id: int | None, text: str, seed: int, share: int, spm_share: int) -> tuple:
    """One row of :func:`transform` without its ``doc_id``."""
    widths = token_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= share or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    ranks = SkipList(widths)
    a, b = ranks.offset(low), ranks.offset(high)
    before, between, behind = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    spm = h4 % 100 < spm_share
    output = behind + before + between if spm else before + behind + between
    return n, "spm" if spm else "psm", a, b - a, output


def transform(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    ``share``: per cent of the texts that are rearranged; ``spm_share``: per cent of these that begin with the suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")))
        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [(i, *rearranged(i, t, seed, share, spm_share)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.

    A rearranged text holds no mark, and no mark can begin inside a text and end inside a mark, so splitting at the marks is exact.
    """
    parts = F.split(output, "<[PSM]>", -1)
    one, two, three = parts[1], parts[2], parts[3]
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """The output of :func:`transform` with digests of the output and of the text rebuilt from it."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )

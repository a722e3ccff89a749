"""Removal of long repeated byte strings by interval expansion on Burrows-Wheeler transforms.

A byte goes when it is covered by a ``LENGTH``-byte string that starts anywhere else too, in another document or in
the same one.

* Every ``LENGTH``-byte window has one anchor: its ``GRAM``-byte string of least hash, the leftmost on ties.  Equal
  windows have equal anchors at the same place, so windows of different anchors need never meet.  Consecutive
  windows with the same anchor form a segment.  Only anchors that occur twice go on.
* Segments with equal content are one class.  All windows of a class with two members are repeated; classes that
  share an anchor are compared with each other, anchors dealt over all tasks.  There they are first halved twice as
  below, which leaves out what shares 48 bytes and not the 312 around them; what is left is compared by a
  Burrows-Wheeler transform of its texts.  Backward extension, breadth first, finds the common-prefix lengths of
  neighbouring suffixes in rising order; it stops at ``LENGTH``, and what is then still open is a repeated window.
* An anchor whose classes have more than ``HOT_BYTES`` is split before that shuffle, so no task gets more of one anchor.
  A window reaches far to the left of its anchor or far to the right, so equal windows also share the longer string
  with that half of the remaining bytes; it becomes the new anchor.  Equal pieces are collapsed again, pieces alone
  with their anchor are done, and what is still too large is split again, until the anchor is the whole window.
* The covered bytes of each document are cut out.  Only documents with a covered byte are shuffled with their text.

Null text counts as empty.  Rows are judged as they stand: a repeated row is a second copy of its text.  Rows that
repeat a ``doc_id`` are told apart by their text; rows with a null ``doc_id`` are returned whole and, having
no name, take no part as copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import give_back, id_and_text, maybe_among, slices, text_bytes
from assayer.llm.shingles import constants, mix
from assayer.session import stored

LENGTH = 400
#: Bytes of an anchor: 32 + 16, made by doubling.
GRAM = 48
#: Text whose grams are hashed at once: its arrays stay in a core's cache.
SLICE_BYTES = 1 << 18
#: Bytes that one transform covers, and windows per piece where one anchor alone has more.
TRANSFORM_BYTES, PIECE_WINDOWS = 3 << 18, 64
#: Halvings of a task's pieces before its transforms.
HALVINGS = 2
#: Bytes of different segments above which an anchor is split into longer ones.
HOT_BYTES = 1 << 20

_BYTE, _DOUBLE = constants(256, 11), constants(8, 12)
_PLACES = 24


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the ``GRAM`` bytes from each position on (fewer positions than bytes)."""
    with np.errstate(over="ignore"):
        value, width, sixteen = _BYTE[data], 1, None
        for step in range(5):
            if width == 16:
                sixteen = value
            value = value[:-width] * _DOUBLE[step] + value[width:]
            width *= 2
        n = len(data) - GRAM + 1
        return mix(value[:n] * _DOUBLE[5] + sixteen[32 : 32 + n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Text number, first window (in the text), windows, anchor place and anchor hash of every segment."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    hashes = gram_hashes(data)
    low = np.uint64((1 << _PLACES) - 1)
    place = (sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    sizes = np.diff(ends)
    room = np.maximum(sizes - length + 1, 0)
    valid = np.repeat(ends[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    if not len(valid):
        return none
    of, at = np.repeat(np.arange(len(sizes)), room), place[valid]
    cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1])))
    first = valid[cut]
    return of[cut], first, np.diff(np.append(cut, len(valid))), at[cut], hashes[at[cut]].view(np.int64)


SEGMENT = "doc_id long, copy long, low long, windows int, lead int, anchor long, class long"


def segment_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            data, ends = text_bytes(piece.column("text"))
            ids, copies = piece.column("doc_id"), piece.column("copy")
            # a very long text is taken in parts that overlap by one window
            for a in range(0, max(len(data), 1), SLICE_BYTES) if piece.num_rows == 1 else [0]:
                part = data[a : a + SLICE_BYTES + length - 1] if piece.num_rows == 1 else data
                of, first, windows, at, anchor = segments(part, np.array([0, len(part)]) if piece.num_rows == 1 else ends, length)
                raw, stop = part.tobytes(), first + windows + length - 1
                kinds = [hashlib.sha256(raw[x:y]).digest()[:8] for x, y in zip(first.tolist(), stop.tolist())]
                low = first + a if piece.num_rows == 1 else first - ends[of]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(of)), copies.take(pa.array(of)), pa.array(low), pa.array(windows.astype(np.int32)),
                        pa.array((at - first).astype(np.int32)), pa.array(anchor), pa.array(np.frombuffer(b"".join(kinds), np.int64)),
                    ],
                    ["doc_id", "copy", "low", "windows", "lead", "anchor", "class"],
                )

    return docs.mapInArrow(run, SEGMENT)


def sorted_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of ``key``, and where a key differs from the one before; ``bits`` hold a place.

    A plain sort of numbers that hold key and place is several times as fast as an argsort.
    """
    if int(key.max()) >> (64 - bits):
        order = np.argsort(key)
        return order, np.append(True, key[order[1:]] != key[order[:-1]])
    both = np.sort((key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
    order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    both >>= np.uint64(bits)
    return order, np.append(True, both[1:] != both[:-1])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes at least, by prefix doubling from as many bytes on as fit a key."""
    n = len(text)
    bits = n.bit_length()
    present = np.bincount(text, minlength=256) > 0
    each = int(present.sum()).bit_length()
    width = max(1, (64 - bits) // each)
    symbols = np.append(np.cumsum(present).astype(np.uint64)[text], np.zeros(width, np.uint64))
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(each)) | symbols[k : k + n]
    while True:
        order, fresh = sorted_places(key, bits)
        if width >= depth or fresh.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        key = rank << np.uint64(bits)
        if width < n:
            key[:-width] |= rank[width:]
        width *= 2


def open_boundaries(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place in it whether the suffix before shares ``length`` bytes or more.

    Level by level, the intervals of strings of one length are extended backward by every byte before them.  The
    right border of an extended interval that is met for the first time has exactly that common-prefix length.
    An interval with one and the same byte before all its suffixes is extended by its ends alone.
    """
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)  # where a suffix stands once its byte before is put in front
    step[by_byte] = np.arange(n, dtype=np.int32)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    preceding[by_byte[1:][same]] = by_byte[:-1][same]
    run = np.cumsum(np.append(False, before[1:] != before[:-1]), dtype=np.int32)
    still_open = np.ones(n + 1, bool)
    still_open[[0, n]] = False
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length):
        alike = run[low] == run[high - 1]
        firsts, lasts = low[alike], high[alike] - 1
        low, high = low[~alike], high[~alike]
        sizes = high - low
        member = np.repeat(low - np.cumsum(sizes, dtype=np.int32) + sizes, sizes)
        member += np.arange(len(member), dtype=np.int32)
        firsts = np.append(firsts, member[preceding[member] < np.repeat(low, sizes)])
        lasts = np.append(lasts, member[following[member] >= np.repeat(high, sizes)])
        low, high = np.sort(step[firsts]), np.sort(step[lasts]) + 1
        new = still_open[high]
        low, high = low[new], high[new]
        still_open[high] = False
        if not len(low):
            break
    return order, still_open[:n]


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its ``length``-byte windows starts anywhere else in the texts."""
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    whole = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # a byte that no UTF-8 text has
    order, tied = open_boundaries(whole, length)
    complete = np.zeros(len(whole), bool)
    for a, size in zip(starts.tolist(), sizes.tolist()):
        complete[a : a + max(0, size - length + 1)] = True
    group = np.cumsum(~tied)
    members = np.bincount(group, weights=complete[order])
    again = np.zeros(len(whole), bool)
    again[order] = members[group] > 1
    return [again[a : a + max(0, size - length + 1)] for a, size in zip(starts.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def compare(group: list[tuple], length: int) -> list[np.ndarray]:
    """:func:`repeated_windows` of ``(anchor, lead, text)`` rows; one anchor with very much text goes in pieces."""
    if sum(len(t) for _, _, t in group) <= 2 * TRANSFORM_BYTES or len({a for a, _, _ in group}) > 1:
        return repeated_windows([t for _, _, t in group], length)
    flags = [np.zeros(len(t) - length + 1, bool) for _, _, t in group]
    for at in range(-max(lead for _, lead, _ in group), length, PIECE_WINDOWS):  # window place less anchor place
        cuts = [(max(0, at + lead), min(len(f), at + lead + PIECE_WINDOWS)) for (_, lead, _), f in zip(group, flags)]
        some = [i for i, (x, y) in enumerate(cuts) if x < y]
        if len(some) > 1:
            # of equal pieces two are enough to tell
            texts = [group[i][2][cuts[i][0] : cuts[i][1] + length - 1] for i in some]
            counts: dict[bytes, int] = {}
            for t in texts:
                counts[t] = min(2, counts.get(t, 0) + 1)
            kinds = list(counts)
            told = dict(zip(kinds, repeated_windows(kinds, length)))
            for i, t in zip(some, texts):
                flags[i][cuts[i][0] : cuts[i][1]] = True if counts[t] > 1 else told[t]
    return flags


PIECE = "doc_id long, copy long, low long, windows int, lead int, slack int, anchor long, piece binary"


def halve(row: tuple, length: int) -> list[tuple]:
    """A piece as up to two pieces with longer anchors, in the columns of ``PIECE``.

    The anchor has all but ``slack`` of the ``length`` bytes of a window.  Windows with half of these before it or more
    are told by the anchor and that half on its left, all others by the anchor and the other half on its right.
    """
    doc_id, copy, low, windows, lead, slack, anchor, text = row
    half, out = (slack + 1) // 2, []
    left = max(0, min(windows, lead - half + 1))
    for a, b, start, rest in ((0, left, lead - half, slack - half), (left, windows, lead - left, half - 1)):
        if a < b:
            part = text[a : b + length - 1]
            key = hashlib.blake2b(part[start : start + length - rest], digest_size=8, salt=b"%d" % rest, key=anchor.to_bytes(8, "little", signed=True))
            out.append((doc_id, copy, low + a, b - a, start, rest, int.from_bytes(key.digest(), "little", signed=True), part))
    return out


def settle(rows: list[tuple], length: int) -> tuple[list[tuple], list[list[tuple]]]:
    """Halve the pieces of one anchor ``HALVINGS`` times: spans found to be repeated, and per longer anchor the pieces still to compare.

    A piece alone with its longer anchor has no repeated window.  Of equal pieces all windows are repeated; one piece
    stands for them where the longer anchor has others.
    """
    found: list[tuple] = []
    groups = [rows]
    for _ in range(HALVINGS):
        anchors: dict[int, dict[bytes, list[tuple]]] = {}
        for row in (row for group in groups for row in group):
            for half in halve(row, length):
                anchors.setdefault(half[6], {}).setdefault(half[7], []).append(half)
        found += [(i, c, low, low + n) for kinds in anchors.values() for same in kinds.values() if len(same) > 1 for i, c, low, n, *_ in same]
        groups = [[same[0] for same in kinds.values()] for kinds in anchors.values() if len(kinds) > 1]
    return found, groups


def _transform(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; each anchor is settled, and longer anchors are put together up to the size of a transform."""
    names = [c.split()[0] for c in PIECE.split(", ")]

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "copy", "low", "high"])

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        flags = compare([(anchor, lead, t) for *_, lead, _, anchor, t in rows], length)
        return out([(i, c, low + x, low + y) for (i, c, low, *_), f in zip(rows, flags) for x, y in _runs(f)])

    def anchors() -> Iterator[list[tuple]]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if rows and rows[-1][6] != row[6]:
                    yield rows
                    rows = []
                rows.append(row)
        if rows:
            yield rows

    held: list[tuple] = []
    found: list[tuple] = []
    held_bytes = 0
    for rows in anchors():
        whole, groups = settle(rows, length)
        found += whole
        for group in groups:
            size = sum(len(row[7]) for row in group)
            # a longer anchor with much text is left alone with itself
            if held and held_bytes + size > TRANSFORM_BYTES:
                yield spans(held)
                held, held_bytes = [], 0
            held += group
            held_bytes += size
        if len(found) >= 10_000:
            yield out(found)
            found = []
    yield out(found)
    if held:
        yield spans(held)
    give_back()


def split_hot(hot: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pieces with anchors of at most ``most`` bytes, and the spans of those found to be repeated as a whole."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    names = ["doc_id", "copy", "low", "windows", "lead", "slack", "anchor", "piece", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [half for row in zip(*(batch.column(c).to_pylist() for c in names[:-1])) for half in halve(row, length)]
            same = [hashlib.blake2b(r[-1], digest_size=8).digest() for r in rows]
            columns = [*(zip(*rows) if rows else [[]] * 8), np.frombuffer(b"".join(same), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    cool, whole = [], []
    while True:
        halves = stored(hot.mapInArrow(run, PIECE + ", class long"), "repeat-halves")
        first = F.min(F.struct("doc_id", "copy", "low", "windows", "lead", "slack")).alias("first")
        classes = stored(halves.groupBy("anchor", "class").agg(F.count(F.lit(1)).alias("n"), first, F.first("piece").alias("piece")), "repeat-kinds")
        whole.append(
            halves.select("doc_id", "copy", "low", "windows", "anchor", "class")
            .join(classes.filter("n > 1").select("anchor", "class"), ["anchor", "class"])
            .select("doc_id", "copy", "low", (F.col("low") + F.col("windows")).alias("high"))
        )
        several = classes.groupBy("anchor").agg(
            F.count(F.lit(1)).alias("kinds"), ((F.sum(F.length("piece")) > most) & (F.min("first.slack") > 0)).alias("hot")
        )
        several = stored(several.filter("kinds > 1").select("anchor", "hot"), "repeat-longer")
        left = classes.join(several, "anchor").select("first.*", "anchor", "piece", "hot")
        cool.append(left.filter("NOT hot").select(*names[:-1]))
        if several.filter("hot").isEmpty():
            break
        hot = left.filter("hot").select(*names[:-1])
    return reduce(DataFrame.unionAll, cool), reduce(DataFrame.unionAll, whole)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def cut(texts: DataFrame, length: int) -> DataFrame:
    """Cut the windows in ``spans`` (array of ``low, high`` window starts, or null) out of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                edge = np.zeros(len(raw) + 1, np.int64)
                for span in spans or ():
                    edge[span["low"]] += 1
                    edge[span["high"] + length - 1] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                rows.append((len(raw), len(raw) - len(kept), len(_runs(covered)), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return texts.select("doc_id", "text", "spans").mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` for every row of ``docs``."""
    texts = id_and_text(docs).withColumn("copy", F.xxhash64("text"))
    rows = stored(segment_rows(texts, length).filter("doc_id IS NOT NULL"), "repeat-segments")
    # stored, so that the join reads plain shuffles and a hot anchor can be split there
    twice = stored(rows.groupBy("anchor").count().filter("count > 1").select("anchor"), "repeat-anchors")
    shared = stored(rows.join(twice, "anchor"), "repeat-shared")

    first = F.min(F.struct("doc_id", "copy", "low", "windows", "lead")).alias("first")
    classes = stored(shared.groupBy("anchor", "class").agg(F.count(F.lit(1)).alias("n"), first), "repeat-classes")
    size = F.sum(F.col("first.windows") + (length - 1))
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), (size > HOT_BYTES).alias("hot"))
    several = stored(several.filter("kinds > 1").select("anchor", "hot"), "repeat-several")
    asked = stored(classes.join(several, "anchor").select("anchor", "hot", "first.*"), "repeat-asked")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, copy, text, wanted in zip(
                batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()
            ):
                raw = text.as_buffer()
                columns = [[w[c] for w in wanted] for c in ("low", "windows", "lead", "anchor")]
                parts = [raw.slice(w["low"], w["windows"] + length - 1).to_pybytes() for w in wanted]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * len(wanted), pa.int64()), pa.array([copy] * len(wanted), pa.int64()),
                        *(pa.array(c, t) for c, t in zip(columns[:3], (pa.int64(), pa.int32(), pa.int32()))),
                        pa.array([length - GRAM] * len(wanted), pa.int32()), pa.array(columns[3], pa.int64()), pa.array(parts, pa.binary()),
                    ],
                    ["doc_id", "copy", "low", "windows", "lead", "slack", "anchor", "piece"],
                )

    def pieces_of(asked: DataFrame) -> DataFrame:
        per_text = asked.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("low", "windows", "anchor", "lead")).alias("wanted"))
        some = maybe_among(texts, "doc_id", asked.select("doc_id")).filter("_maybe").dropDuplicates(["doc_id", "copy"])
        return some.join(per_text, ["doc_id", "copy"]).select("doc_id", "copy", "text", "wanted").mapInArrow(pieces, PIECE)

    found = pieces_of(asked.filter("NOT hot"))
    wholly = shared.join(classes.filter("n > 1").select("anchor", "class"), ["anchor", "class"]).select(
        "doc_id", "copy", "low", (F.col("low") + F.col("windows")).alias("high")
    )
    if not several.filter("hot").isEmpty():
        cool, whole = split_hot(pieces_of(asked.filter("hot")), length, HOT_BYTES)
        found, wholly = found.unionAll(cool), wholly.unionAll(whole)
    partly = found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda b: _transform(b, length), "doc_id long, copy long, low long, high long"
    )
    spans = stored(
        partly.unionAll(wholly).distinct().groupBy("doc_id", "copy").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "repeat-spans"
    )
    marked = maybe_among(texts, "doc_id", spans.select("doc_id"))
    touched = marked.filter("_maybe").join(spans, ["doc_id", "copy"], "left").select("doc_id", "text", "spans")
    whole = F.col("text").cast("binary")
    nothing = F.lit(0).cast("long")
    untouched = marked.filter(~F.col("_maybe")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"),
        F.sha2(whole, 256).alias("kept_sha256"), whole.alias("kept_text"),
    )
    return cut(touched, length).unionByName(untouched)

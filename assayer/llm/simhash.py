"""Near-duplicate documents by SimHash: a binary trie of fingerprints joined with itself.

1. Every text becomes one 64-bit fingerprint: the majority of each bit over the XXH64 hashes of its three-word shingles.
   Documents with equal fingerprints are one class; only classes (with their least ``doc_id``) go on.
2. Fingerprints at most three bits apart agree in one of four 16-bit quarters, so each class is dealt once per quarter
   under that quarter's value.  A value that more than ``MOST_LEAVES`` classes share is split again, as often as need be:
   its classes also agree in one of four parts of the bits that are left.  At most ``2 ** bits`` classes are left for
   the last bits, so splitting ends by itself and no class is left out.
3. The classes of one value are the leaves of a binary trie over the bits that are left.  Pairs of nodes are walked down
   together: the bits in which they differ are added up, and a pair beyond the budget is dropped with all leaves below it.
   A pair whose leaves already are in one component is dropped too, so a dense group costs links, not pairs.
4. The links of all tries are joined to components.

Null text counts as empty; a text without words has fingerprint zero and is linked like any other.  Rows that repeat a
``doc_id`` are one document with the links of all its rows.  A row with a null ``doc_id`` gets its fingerprint, links
nothing and has no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import id_and_text, maybe_among, slices
from assayer.llm.components import components
from assayer.session import stored

# fixed values: words per shingle, seed of the hash, differing bits of a link
WORDS, SEED, BUDGET = 3, 42, 3
#: Classes that one trie holds at most, node pairs that a step looks at, rows that a task joins at once.
MOST_LEAVES, STEP_PAIRS, TASK_ROWS = 1 << 15, 1 << 16, 1 << 17
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """The bits that are set in over half of the shingle hashes."""
    words = text.translate(_LOWER).split()  # ASCII white space, as bytes know it: space and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, COUNTED):
        octets = hashes[k : k + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint ``print`` (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, print long")


def finer(mask: int) -> list[int]:
    """``mask`` with one of four parts of the other bits: at most three differing bits leave one part alike."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [free[len(free) * k // 4 : len(free) * (k + 1) // 4] for k in range(4)]
    return [mask | sum(1 << b for b in part) for part in parts]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _key() -> Column:
    return F.xxhash64("mask", F.col("print").bitwiseAND(F.col("mask")))


def dealt(classes: DataFrame, most: int = MOST_LEAVES) -> DataFrame:
    """``mask, key, print, rep``: the classes under every value they may share with a near one, at most ``most`` a key."""
    if most < 16:
        raise ValueError("a trie must be allowed 16 leaves, or splitting need not end")
    spark = classes.sparkSession
    quarters = F.array(*[F.lit(_signed(m)) for m in finer(0)])
    rows = classes.select(F.explode(quarters).alias("mask"), "print", "rep").withColumn("key", _key())
    done = None
    while True:
        hot = stored(rows.groupBy("key", "mask").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).drop("n"), "simhash-hot")
        masks = [r["mask"] for r in hot.select("mask").distinct().collect()]  # at most 1,024: by then 2 ** 15 values are left
        if not masks:
            return rows if done is None else done.unionByName(rows)
        # a key that is taken for a hot one is split as well, with all its rows: nothing is lost by that
        marked = maybe_among(rows, "key", hot.select("key")).withColumn("_maybe", F.col("_maybe") & F.col("mask").isin(masks))
        calm = marked.filter(~F.col("_maybe")).drop("_maybe")
        done = calm if done is None else done.unionByName(calm)
        steps = [(m, _signed(f)) for m in masks for f in finer(m & (1 << 64) - 1)]
        table = F.broadcast(spark.createDataFrame(steps, "mask long, finer long"))
        split = marked.filter("_maybe").drop("_maybe", "key").join(table, "mask").select(F.col("finer").alias("mask"), "print", "rep")
        # two ways of splitting may lead to the same bits
        rows = stored(split.dropDuplicates(["mask", "print"]).withColumn("key", _key()), "simhash-split")


def left_bits(prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint outside its mask, moved to the top in their order."""
    out = np.zeros(len(prints), np.uint64)
    for mask in np.unique(masks):
        rows = np.flatnonzero(masks == mask)
        free = [b for b in range(63, -1, -1) if not int(mask) >> b & 1]
        for place, b in enumerate(free):
            out[rows] |= ((prints[rows] >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - place)
    return out


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (every entry points at its component's least place) after linking the places ``a`` and ``b``."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(label, up := label[label]):
            label = up


class Trie:
    """Binary tries of several groups over sorted leaves; a node is a range of leaves with the same leading bits."""

    def __init__(self, group: np.ndarray, bits: np.ndarray) -> None:
        self.order = np.lexsort((bits, group))
        self.bits, group = bits[self.order], group[self.order]
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        self.roots = np.append(0, ends[:-1]), ends
        self._ones: dict[int, np.ndarray] = {}

    def middle(self, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
        """Where the one-child of each node begins."""
        if level not in self._ones:
            bit = (self.bits >> np.uint64(63 - level)) & np.uint64(1)
            self._ones[level] = np.append(0, np.cumsum(bit.astype(np.int32)))
        ones = self._ones[level]
        return high - (ones[high] - ones[low])

    def components(self, budget: int = BUDGET, step_pairs: int = STEP_PAIRS) -> np.ndarray:
        """For every leaf (in sorted order) the first leaf of its component."""
        label = np.arange(len(self.bits))
        low, high = self.roots
        many = high - low > 1
        low, high = low[many], high[many]
        open_ = [(0, np.stack([low, high, low, high, np.zeros_like(low)]))] if len(low) else []
        while open_:
            level, pairs = open_.pop()
            if pairs.shape[1] > step_pairs:  # the rest waits, so memory stays bounded
                open_ += [(level, pairs[:, step_pairs:]), (level, pairs[:, :step_pairs])]
                continue
            a, a_end, b, b_end, apart = pairs
            turns = np.append(0, np.cumsum(label[1:] != label[:-1]))
            one = (turns[a] == turns[a_end - 1]) & (turns[b] == turns[b_end - 1]) & (label[a] == label[b])
            leaves = (a_end - a == 1) & (b_end - b == 1) & ~one
            left, right = a[leaves], b[leaves]
            near = np.bitwise_count(self.bits[left] ^ self.bits[right]) <= budget
            label = joined_labels(label, left[near], right[near])
            go = ~one & ~leaves
            if go.any():
                a, a_end, b, b_end, apart = pairs[:, go]
                a_mid, b_mid, alone = self.middle(a, a_end, level), self.middle(b, b_end, level), a == b
                below = np.concatenate(
                    [
                        np.stack([a, a_mid, b, b_mid, apart]), np.stack([a_mid, a_end, b_mid, b_end, apart]),
                        np.stack([a, a_mid, b_mid, b_end, apart + 1]), np.stack([a_mid, a_end, b, b_mid, apart + 1])[:, ~alone],
                    ],
                    axis=1,
                )
                a, a_end, b, b_end, apart = below
                # no empty child, no leaf with itself, nothing beyond the budget
                fits = (a < a_end) & (b < b_end) & (apart <= budget) & ((a != b) | (a_end - a > 1))
                if fits.any():
                    open_.append((level + 1, below[:, fits]))
        return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the keys of a task's rows, which come sorted by mask and key."""

    def found(part: pa.Table) -> pa.RecordBatch:
        mask, key, prints, rep = (part.column(c).to_numpy() for c in ("mask", "key", "print", "rep"))
        group = np.append(0, np.cumsum((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        trie = Trie(group, left_bits(prints.view(np.uint64), mask.view(np.uint64)))
        label = trie.components()
        rep = rep[trie.order]
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_ROWS:
            part = pa.Table.from_batches(held).combine_chunks()
            mask, key = part.column("mask").to_numpy(), part.column("key").to_numpy()
            turns = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
            if len(turns):  # the last key may go on in the next batch
                yield found(part.slice(0, int(turns[-1]) + 1))
                part = part.slice(int(turns[-1]) + 1)
            held = part.to_batches()
    if held:
        yield found(pa.Table.from_batches(held).combine_chunks())


def links(classes: DataFrame, most: int = MOST_LEAVES) -> DataFrame:
    """``a, b``: links that join all ``rep`` whose fingerprints hang together, from ``print, rep`` with distinct prints."""
    rows = dealt(classes, most).repartition("mask", "key").sortWithinPartitions("mask", "key")
    return rows.select("mask", "key", "print", "rep").mapInArrow(_links, "a long, b long")


def decide(docs: DataFrame, most: int = MOST_LEAVES) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    rows = stored(fingerprints(docs), "simhash-prints")
    known = rows.filter("doc_id IS NOT NULL")
    classes = stored(known.groupBy("print").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    # a repeated doc_id with different texts ties its classes together
    torn = known.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low != high").select("doc_id")
    tied = known.join(torn, "doc_id", "left_semi").join(classes, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(links(classes, most).unionAll(tied), "simhash-links")
    labels = stored(
        classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id")),
        "simhash-labels",
    )
    return rows.join(labels, "print", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )

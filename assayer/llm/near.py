"""Near-duplicate documents by MinHash bands, odd sketches and exact verification.

Every text becomes its set of five-word shingles, 128 MinHash values, 32 band keys of four values, and an odd sketch:
the values folded into a 512-bit parity bitmap, where the number of differing bits between two sketches estimates a high
similarity precisely.  Texts with equal sets are one class; only class representatives (the least ``doc_id``) go on.

1. In every band bucket each member is paired with the bucket's least member.  Pairs whose sketches rule out the
   threshold are dropped, the rest is verified on the full sets, and the links are joined to components.
2. A bucket whose members still belong to several components is looked at as a whole: members outside the
   component of the least one are compared with all others (sketch first, then full sets) inside one task, and
   only links that join two components come out.
3. Members of such a bucket with more than ``BLOCK`` members meet again over a finer key, without a loss: with the
   rarest shingles first, a pair at the threshold shares one of the first 1/7 of the smaller set and the first 1/4 of
   the larger.  Documents that share only a common template don't meet there.  A shingle that still has very many
   members is dealt over tiles of two blocks.

A pair at the threshold shares a band with a probability above 0.99999, and is dropped by its sketch with one below
1e-7.  No list of all pairs of a group is ever made.

Null text counts as empty; texts without words have no shingle and are linked with nothing.  Rows that repeat a
``doc_id`` are one document with the links of all its rows.  A row with a null ``doc_id`` is linked with nothing and kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import give_back, id_and_text, maybe_among, rows_aside, slices, text_bytes
from assayer.llm.components import components
from assayer.llm.shingles import constants, mix, shingle_sets
from assayer.session import stored

BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
SKETCH_BITS = 512
#: Similarity as a ratio of whole numbers, and the sketch estimate below which a pair can't reach it.
SHARE, OF = 75, 100
LEAST_ESTIMATE = 0.5
#: Members of a bucket that are compared in one task; the members of a larger one meet over their rare shingles.
BLOCK = 4096
#: Counters of how common shingles are; they steer the order of shingles, which any values leave exact.
COUNTERS = 1 << 18
SLICE_BYTES = 2 << 20

_TIMES, _FLIP = constants(HASHES, 5), constants(HASHES, 6)
_IN_BAND, _BAND, _FOLD = constants(BAND_ROWS, 7), constants(BANDS, 8), constants(HASHES, 9)


def minhash(found: np.ndarray) -> np.ndarray:
    """The 128 least values of a non-empty set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 4096):
            values = found[None, at : at + 4096] ^ _FLIP[:, None]
            values *= _TIMES[:, None]
            np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((least.reshape(BANDS, BAND_ROWS) * _IN_BAND).sum(axis=1) + _BAND).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity of how many values fall on each bit."""
    with np.errstate(over="ignore"):
        bit = (mix(least + _FOLD) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def most_differing_bits() -> int:
    """The bits in which two sketches differ on average at the least estimate, from 2k(1-J) folded values."""
    folded = 2 * HASHES * (1 - LEAST_ESTIMATE)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** folded))


def pack(found: np.ndarray) -> bytes:
    """A sorted set as its highest 48 bits, six bytes each."""
    return np.ascontiguousarray(found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.int64)


def set_key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def linked(shared, size_a, size_b):
    return OF * shared >= SHARE * (size_a + size_b - shared)


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """The shingle set of every text with its key, bands and sketch (null where the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            sets = shingle_sets(*text_bytes(piece.column("text")))
            least = [minhash(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.array([None if m is None else band_keys(m) for m in least], pa.list_(pa.int64())),
                    pa.array([None if m is None else odd_sketch(m) for m in least], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return id_and_text(docs).mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame:
    """``rep, members``: the shingle sets of the given class representatives.

    A bit filter of bounded size over their ids goes to every task, so texts of other documents are neither
    shingled again nor shuffled.  When the filter is full it lets more pass and the join behind it decides alone.
    """
    texts = maybe_among(id_and_text(docs), "doc_id", reps).filter("_maybe").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            sets = shingle_sets(*text_bytes(piece.column("text")))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([pack(s) for s in sets], pa.binary())],
                ["rep", "set_key", "members"],
            )

    found = texts.mapInArrow(run, "rep long, set_key binary, members binary")
    # a repeated doc_id may have other texts, or the same text twice
    exact = found.join(classes.select("rep", "set_key").join(reps, "rep"), ["rep", "set_key"])
    return exact.groupBy("rep").agg(F.first("members").alias("members"))


def differing_bits(a: Column, b: Column) -> Column:
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x.cast("int"))


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs ``a, b`` of class representatives whose full sets reach the threshold."""
    sketches = classes.select("rep", "sketch")
    near = (
        pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        .join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        .filter(differing_bits(F.col("sketch_a"), F.col("sketch_b")) <= most_differing_bits()).select("a", "b")
    )
    with_sets = near.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("set_a"), batch.column("set_b")):
                one, two = unpack(left.as_py()), unpack(right.as_py())
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(linked(shared, len(one), len(two)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return with_sets.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def bucket_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join different components among the members of one bucket (or block of it)."""
    group = group.drop_duplicates("rep").sort_values(["minor", "rep"], kind="stable")
    label, minor = group["label"].to_numpy().copy(), group["minor"].to_numpy(bool)
    sets = [unpack(m) for m in group["members"]]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sketches = np.stack(group["sketch"].to_list()).astype(np.int64).view(np.uint64)
    marked, most, out = np.zeros(len(distinct), bool), most_differing_bits(), []
    for x in np.flatnonzero(minor):
        other = label != label[x]
        if not other.any():
            continue
        near = other & (np.bitwise_count(sketches ^ sketches[x]).sum(axis=1) <= most)
        if not near.any():
            continue
        own = ids[starts[x] : starts[x] + sizes[x]]
        marked[own] = True
        shared = np.add.reduceat(marked[ids], starts, dtype=np.int64)
        marked[own] = False
        for y in np.flatnonzero(near & linked(shared, sizes, sizes[x])):
            if label[y] != label[x]:
                low, high = sorted((int(label[x]), int(label[y])))
                out.append((high, low))
                label[label == high] = low
    if len(ids) > 1 << 18:
        del sets, ids, distinct, sketches, marked
        give_back()
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def tile_links(group: pd.DataFrame) -> pd.DataFrame:
    """:func:`bucket_links` where a member may stand twice: among the compared and among the others."""
    return bucket_links(group.sort_values("minor", ascending=False, kind="stable").drop_duplicates("rep"))


def prefix_lengths(n: int) -> tuple[int, int]:
    """How many first shingles of a set of ``n`` meet as the smaller and as the larger set of a pair."""
    return n + 1 - -(-2 * SHARE * n // (SHARE + OF)), n + 1 - -(-SHARE * n // OF)


def rare_shingles(crowd: DataFrame) -> DataFrame:
    """``token, rep, label, indexed``: the rarest shingles of every set; ``indexed`` where it meets as the smaller."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column("members"):
                np.add.at(total, unpack(raw.as_py()) % COUNTERS, 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    counted = crowd.select("members").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)  # at most COUNTERS rows reach the driver
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, label, raw in zip(batch.column("rep").to_pylist(), batch.column("label").to_pylist(), batch.column("members")):
                found = unpack(raw.as_py())
                smaller, larger = prefix_lengths(len(found))
                token = found[np.lexsort((found, often[found % COUNTERS]))[:larger]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(np.full(larger, rep)), pa.array(np.full(larger, label)), pa.array(np.arange(larger) < smaller)],
                    ["token", "rep", "label", "indexed"],
                )

    return crowd.mapInArrow(run, "token long, rep long, label long, indexed boolean")


def crowded_links(crowd: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that join different components among all of ``crowd`` (``rep, label``), in tasks of two blocks at most."""
    rows = stored(rare_shingles(crowd.join(sets, "rep").select("rep", "label", "members")), "near-rare")
    many = F.count(F.lit(1)) > BLOCK
    alike = F.when(many, F.bit_xor(F.xxhash64("rep", "indexed"))).otherwise(F.bit_xor(F.xxhash64("rep")))
    groups = (
        rows.groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if("indexed").alias("smaller"), alike.alias("alike"),
            F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "rep").alias("major"),
        )
        .filter("smaller > 0 AND low != high").groupBy("n", "alike")
        .agg(F.min("token").alias("token"), F.min_by("smaller", "token").alias("smaller"), F.min_by("major", "token").alias("major"))
    )
    members = stored(rows.join(stored(groups.drop("alike"), "near-tokens"), "token"), "near-crowded")
    outside = F.col("label") != F.col("major")
    sized = stored(members.groupBy("token").agg(F.count_if(outside).alias("outside")), "near-outside")
    # a pair to be found has one member outside the component of the least, and one that is indexed: the fewer are compared
    fewer, block = F.least("outside", "smaller"), F.col("n") > BLOCK
    members = members.join(sized, "token").select(
        "token", "rep", "label", F.when(block & (F.col("smaller") < F.col("outside")), F.col("indexed")).otherwise(outside).alias("minor"),
        F.when(block, F.ceil(fewer / BLOCK)).otherwise(1).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("columns"),
    )

    def place(blocks: str) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(blocks)), F.col(blocks)).cast("int")

    compared = members.filter("minor").withColumn("x", place("rows")).withColumn("y", F.explode(F.expr("sequence(0, columns - 1)")))
    others = members.filter("NOT minor OR columns > 1").withColumn("minor", F.lit(False))
    others = others.withColumn("x", F.explode(F.expr("sequence(0, rows - 1)"))).withColumn("y", place("columns"))
    dealt = compared.unionByName(others).select("token", "x", "y", "rep", "label", "minor")
    wide = dealt.join(sets, "rep").join(classes.select("rep", "sketch"), "rep")
    return wide.groupBy("token", "x", "y").applyInPandas(tile_links, "a long, b long")


def near_components(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``set_key`` and the ``component_id`` of its class, from ``docs`` and the stored output of :func:`sign`."""
    some = signed.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = stored(
        some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "near-classes",
    )
    # a repeated doc_id with different texts ties its classes together
    own = some.select("doc_id", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key")
    least = own.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("a != b")
    tied = own.join(least.select("doc_id", "b"), "doc_id").select(F.col("rep").alias("a"), "b").filter("a != b")

    rows = classes.select(F.explode("bands").alias("band"), "rep")
    buckets = stored(
        rows.groupBy("band").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("alike"))
        .filter("n > 1"), "near-buckets",
    )
    shared = stored(rows.join(buckets, "band").select("band", "rep", "b", "n", "alike"), "near-members")
    pairs = shared.filter("rep != b").select(F.col("rep").alias("a"), "b").distinct()
    sets = stored(sets_of(docs, shared.select("rep").distinct(), classes), "near-candidates")
    first = components(verified(pairs, classes, sets).unionAll(tied), "near-links")

    labelled = shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "rep", "b", "n", "alike", F.coalesce("component", "rep").alias("label")
    )
    # buckets of two are settled above; buckets with the same members are looked at once
    open_ = (
        labelled.filter("n > 2").groupBy("band", "n", "alike")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "rep").alias("major"))
        .filter("low != high").groupBy("n", "alike").agg(F.min("band").alias("band"), F.min_by("major", "band").alias("major"))
    )
    open_ = stored(open_, "near-open")
    members = labelled.select("band", "rep", "label").join(open_.select("band", "n", "major"), "band")
    few = members.filter(F.col("n") <= BLOCK).select("band", "rep", "label", (F.col("label") != F.col("major")).alias("minor"))
    wide = few.join(sets, "rep").join(classes.select("rep", "sketch"), "rep")
    more = wide.groupBy("band").applyInPandas(bucket_links, "a long, b long")
    if not open_.filter(F.col("n") > BLOCK).isEmpty():
        crowd = stored(members.filter(F.col("n") > BLOCK).select("rep", "label").distinct(), "near-crowd")
        more = more.unionAll(crowded_links(crowd, sets, classes))
    second = components(more, "near-more")

    final = (
        classes.select("set_key", "rep").join(first.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
        .join(second.select(F.col("node").alias("label"), F.col("component").alias("last")), "label", "left")
    )
    return final.select("set_key", F.coalesce("last", "label").alias("component_id"))


def decide(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    signed = stored(sign(docs), "near-sets")
    labels = near_components(docs, signed)
    rows = signed.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays for its group, all columns as they were.

    Only rows that may belong to a dropped document are shuffled; all others pass by a filter of bounded size.
    """
    dropped = stored(decide(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct(), "near-dropped")
    marked = maybe_among(rows_aside(docs, id=F.col("doc_id").cast("long")), "id", dropped)
    plain = marked.filter(~F.col("_maybe")).select("_row")
    return plain.unionAll(marked.filter("_maybe").join(dropped, "id", "left_anti").select("_row")).select("_row.*")

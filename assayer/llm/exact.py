"""Exact dedup with a cuckoo-filter index over content digests.

The index holds one 16-bit fingerprint per live digest in one of two buckets, and beside each fingerprint the row of
the full digest in the bucketed key store.  A filter hit counts only once the stored 256-bit digest is equal; a miss
is certain.  When an insertion finds no free slot after a bounded walk, the filter is built anew at twice the size
from the stored keys.  Digests can be deleted; their slots and rows become free.

Every scan task first runs its own rows through such an index (so a group of copies of any size leaves a task as one
row), then the distinct digests meet in shards by digest.  Only ids and digests are moved, never texts.

Null text counts as empty; empty texts are equal to each other.  A row that repeats a ``doc_id`` with the same text is the
same document: both rows carry the same decision.  A null ``doc_id`` is smaller than any other; it is kept only if its group has no
other id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ascii_lower, id_and_text, maybe_among, rows_aside
from assayer.session import stored

SLOTS = 4
KICKS = 500
#: Digests that a scan task collects before it hands them on; bounds its memory only.
TASK_DIGESTS = 200_000
#: Digests of one shard of the index.
SHARD_DIGESTS = 500_000
NO_ID = np.iinfo(np.int64).min


class CuckooIndex:
    """Fingerprints in two candidate buckets per digest, with the digests stored by row."""

    def __init__(self, capacity: int = 1024) -> None:
        self.keys = np.zeros((max(16, capacity), 4), np.uint64)
        self.live = np.zeros(len(self.keys), bool)
        self.free: list[int] = []
        self.used = 0
        self._empty_table(max(4, 1 << int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85)))))

    def __len__(self) -> int:
        return int(self.live.sum())

    def _empty_table(self, buckets: int) -> None:
        self.mask = np.uint64(buckets - 1)
        self.marks = np.zeros((buckets, SLOTS), np.uint16)
        self.rows = np.full((buckets, SLOTS), -1, np.int64)

    def _marks_of(self, words: np.ndarray) -> np.ndarray:
        return np.maximum(words[:, 0] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (bucket ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def find(self, words: np.ndarray) -> np.ndarray:
        """The row of each digest, -1 where it is not live."""
        marks, first = self._marks_of(words), words[:, 1] & self.mask
        out = np.full(len(words), -1, np.int64)
        for bucket in (first, self._other(first, marks)):
            hit, slot = np.nonzero(self.marks[bucket] == marks[:, None])
            row = self.rows[bucket[hit], slot]
            same = (self.keys[row] == words[hit]).all(axis=1)  # the stored digest decides
            out[hit[same]] = row[same]
        return out

    def insert(self, words: np.ndarray) -> np.ndarray:
        """Insert digests that are distinct and not live; returns their rows."""
        reused = np.array([self.free.pop() for _ in range(min(len(self.free), len(words)))], np.int64)
        rows = np.concatenate([reused, self.used + np.arange(len(words) - len(reused))]).astype(np.int64)
        self.used += len(words) - len(reused)
        if self.used > len(self.keys):
            more = max(self.used, 2 * len(self.keys)) - len(self.keys)
            self.keys = np.concatenate([self.keys, np.zeros((more, 4), np.uint64)])
            self.live = np.concatenate([self.live, np.zeros(more, bool)])
        self.keys[rows], self.live[rows] = words, True
        if not self._place(rows):
            self._resize()
        return rows

    def delete(self, words: np.ndarray) -> np.ndarray:
        """Delete distinct digests; returns the rows that were live and are free now."""
        rows = self.find(words)
        rows = rows[rows >= 0]
        gone = self.keys[rows]
        marks, first = self._marks_of(gone), gone[:, 1] & self.mask
        for bucket in (first, self._other(first, marks)):
            hit, slot = np.nonzero(self.rows[bucket] == rows[:, None])
            self.marks[bucket[hit], slot], self.rows[bucket[hit], slot] = 0, -1
        self.live[rows] = False
        self.free += rows.tolist()
        return rows

    def _place(self, rows: np.ndarray) -> bool:
        marks, first = self._marks_of(self.keys[rows]), self.keys[rows, 1] & self.mask
        for second in (False, True):
            bucket = self._other(first, marks) if second else first
            for _ in range(SLOTS):
                # one newcomer a round takes the first free slot of each bucket
                space = self.marks[bucket] == 0
                open_ = np.flatnonzero(space.any(axis=1))
                if not len(open_):
                    break
                _, one = np.unique(bucket[open_], return_index=True)
                taken = open_[one]
                slot = space[taken].argmax(axis=1)
                self.marks[bucket[taken], slot], self.rows[bucket[taken], slot] = marks[taken], rows[taken]
                rest = np.ones(len(rows), bool)
                rest[taken] = False
                rows, marks, first, bucket = rows[rest], marks[rest], first[rest], bucket[rest]
                if not len(rows):
                    return True
        return all(self._kick(int(row)) for row in rows)

    def _kick(self, row: int) -> bool:
        mark = self._marks_of(self.keys[row : row + 1])
        bucket = self.keys[row : row + 1, 1] & self.mask
        for step in range(KICKS):
            space = np.flatnonzero(self.marks[bucket[0]] == 0)
            slot = space[0] if len(space) else (row + step) % SLOTS
            held_mark, held = self.marks[bucket[0], slot].copy(), int(self.rows[bucket[0], slot])
            self.marks[bucket[0], slot], self.rows[bucket[0], slot] = mark[0], row
            if len(space):
                return True
            mark, row = np.array([held_mark], np.uint16), held
            bucket = self._other(bucket, mark)
        return False

    def _resize(self) -> None:
        rows, buckets = np.flatnonzero(self.live), len(self.marks)
        while True:
            buckets *= 2
            self._empty_table(buckets)
            if self._place(rows):
                return


class Groups:
    """A cuckoo index with, for each live digest, the largest id and the number of rows."""

    def __init__(self, capacity: int = 1024) -> None:
        self.index = CuckooIndex(capacity)
        self.largest, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if not len(words):
            return
        order = np.lexsort(words.T)
        words, ids, sizes = words[order], ids[order], sizes[order]
        begins = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
        words, ids, sizes = words[begins], np.maximum.reduceat(ids, begins), np.add.reduceat(sizes, begins)
        rows = self.index.find(words)
        new = rows < 0
        rows[new] = self.index.insert(words[new])
        if (more := len(self.index.keys) - len(self.sizes)) > 0:
            self.largest = np.concatenate([self.largest, np.full(more, NO_ID)])
            self.sizes = np.concatenate([self.sizes, np.zeros(more, np.int64)])
        self.largest[rows[new]], self.sizes[rows[new]] = NO_ID, 0
        self.largest[rows] = np.maximum(self.largest[rows], ids)
        self.sizes[rows] += sizes

    def remove(self, words: np.ndarray) -> None:
        if len(words):
            self.index.delete(np.unique(words, axis=0))

    def table(self) -> pa.RecordBatch:
        rows = np.flatnonzero(self.index.live)
        raw = pa.py_buffer(np.ascontiguousarray(self.index.keys[rows]).tobytes())
        ends = pa.py_buffer((np.arange(len(rows) + 1) * 32).astype(np.int32).tobytes())
        digests = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, raw])
        ids = pa.array(self.largest[rows], mask=self.largest[rows] == NO_ID)
        return pa.RecordBatch.from_arrays([digests, ids, pa.array(self.sizes[rows])], ["digest", "keep_id", "group_size"])


GROUP_SCHEMA = "digest binary, keep_id long, group_size long"


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _collect(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    groups = Groups()
    for batch in batches:
        ids = batch.column("keep_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        groups.add(_words(batch.column("digest")), ids, batch.column("group_size").to_numpy(zero_copy_only=False))
        if limit and len(groups.index) > limit:
            yield groups.table()
            groups = Groups()
    yield groups.table()


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per live digest, with its largest id and its number of rows, from ``digest, keep_id, group_size``."""
    spark = rows.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_DIGESTS))
    local = rows.mapInArrow(lambda b: _collect(b, TASK_DIGESTS), GROUP_SCHEMA)
    return local.repartition(shards, "digest").mapInArrow(lambda b: _collect(b, None), GROUP_SCHEMA)


def update_index(index: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """Apply insertions and deletions to an index of ``digest, keep_id, group_size``.

    ``changes`` has ``digest, doc_id, added`` (false: the digest leaves the index with its whole group).
    Within one call deletions come first, so a digest that is deleted and added holds only what was added.
    """

    def run(_, have: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        groups = Groups(len(have) + len(change))
        words = lambda s: np.frombuffer(b"".join(s), np.uint64).reshape(-1, 4)
        ids = lambda s: s.fillna(NO_ID).to_numpy(np.int64) if s.isna().any() else s.to_numpy(np.int64)
        groups.add(words(have["digest"]), ids(have["keep_id"]), have["group_size"].to_numpy(np.int64))
        out, into = change[~change["added"].astype(bool)], change[change["added"].astype(bool)]
        groups.remove(words(out["digest"]))
        groups.add(words(into["digest"]), ids(into["doc_id"]), np.ones(len(into), np.int64))
        return groups.table().to_pandas()

    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    have = index.select(shard, "digest", "keep_id", "group_size").groupBy("shard")
    change = changes.select(shard, "digest", "doc_id", "added").groupBy("shard")
    return have.cogroup(change).applyInPandas(run, GROUP_SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the 256-bit digest of the text with A-Z lowered."""
    return id_and_text(docs).select("doc_id", F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"))


def decide(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    rows = stored(digests(docs), "exact-digests")
    # stored, so that the join below reads plain shuffles and a hot digest can be split there
    groups = stored(
        group_digests(rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))), "exact-groups"
    )
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays, all columns as they were; of rows with one ``doc_id`` and equal texts one stays.

    Only rows whose key may be among those to look at are shuffled; all others pass by a filter of bounded size.
    """
    decided = decide(docs).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"), "kept")
    seen = decided.groupBy("id", "digest").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    key = F.xxhash64("id", "digest").alias("key")
    watched = stored(seen.filter("id IS NOT NULL AND (n > 1 OR NOT stays)").select(key, "id", "digest", "stays"), "exact-watched")
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    rows = rows_aside(docs, id=F.col("doc_id").cast("long"), digest=digest)
    marked = maybe_among(rows.withColumn("key", F.xxhash64("id", "digest")), "key", watched.select("key"))
    plain = marked.filter(~F.col("_maybe")).select("_row")
    asked = marked.filter("_maybe").join(watched.select("id", "digest", "stays"), ["id", "digest"], "left")
    unwatched = asked.filter("stays IS NULL").select("_row")
    once = asked.filter("stays").dropDuplicates(["id", "digest"]).select("_row")
    return plain.unionAll(unwatched).unionAll(once).select("_row.*")

"""Byte-level BPE by merge replay over all distinct words of a slice of the corpus.

Every task replays the merges of the rank file over the distinct words it meets: an inverted index leads from a
rank (a token pair) to the positions where the pair stands, ranks are applied in order, and after a merge only the
two pairs beside it are looked up anew.  Words met before are kept in a bounded cache, so common words are merged
once per task.  There is no shuffle; a lost task is simply run again.

Null text counts as empty and has no tokens.  Rows are independent: a repeated ``doc_id`` gives repeated rows and
a null one stays null.  Texts of any length are handled whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assayer.llm.common import id_and_text, slices

#: Distinct words that a task keeps between slices; beyond it the cache starts anew.
CACHE_WORDS = 100_000
#: Text that a task encodes at once.
SLICE_BYTES = 2 << 20
NONE = np.int64(1 << 40)


class Ranks:
    """A rank file with the rank of every pair of tokens that joins to a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.size = max(self.ids.values()) + 1
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    ranks.append(rank)
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(1 << 62))
        self.key_ranks = np.append(np.array(ranks, np.int64)[order], NONE)
        tokens = [b""] * self.size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[source].tobytes()

    def merge_one(self, word: bytes) -> list[int]:
        """The lowest-ranked pair first, leftmost on ties, one merge at a time."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def replay(self, words: Sequence[bytes]) -> list[list[int]]:
        """The ids of each word, by applying every merge of the file to all words at once."""
        sizes = np.array([len(w) for w in words], np.int64)
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        if not n:
            return [[] for _ in words]
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        filled = sizes > 0
        after[ends[filled] - 1] = -1
        before[(ends - sizes)[filled]] = -1
        word_of = np.repeat(np.arange(len(words)), sizes)
        rank_at = np.full(n, NONE)
        has = np.flatnonzero(after >= 0)
        rank_at[has] = self.pair_ranks(token[has], token[has + 1])
        alive = np.ones(n, bool)
        odd = np.zeros(len(words), bool)
        # the inverted index: the positions of a rank, as found at the start and as they come up
        order = np.argsort(rank_at, kind="stable")
        ranks, firsts = np.unique(rank_at[order], return_index=True)
        lasts = np.append(firsts[1:], n)
        index = {int(r): [order[a:b]] for r, a, b in zip(ranks, firsts, lasts) if r != NONE}
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            if len(at) > 1 and (linked := after[at[:-1]] == at[1:]).any():
                # in a run such as aaaa every other pair is merged, from the left
                begins = np.append(True, ~linked)
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            gone = after[at]
            right, left = after[gone], before[at]
            token[at] = rank
            alive[gone] = False
            rank_at[gone] = NONE
            after[at] = right
            inner = right >= 0
            before[right[inner]] = at[inner]
            left = before[at]
            rank_at[at] = NONE
            a, b = at[inner], left[left >= 0]
            rank_at[a] = self.pair_ranks(token[a], token[right[inner]])
            rank_at[b] = self.pair_ranks(token[b], token[after[b]])
            touched = np.concatenate([a, b])
            fresh = rank_at[touched]
            keep = fresh < NONE
            touched, fresh = touched[keep], fresh[keep]
            if not len(touched):
                continue
            if len(touched) > 1:
                by = np.argsort(fresh, kind="stable")
                touched, fresh = touched[by], fresh[by]
                cuts = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
                groups = zip(fresh[np.append(0, cuts)].tolist(), np.split(touched, cuts) if len(cuts) else [touched])
            else:
                groups = [(int(fresh[0]), touched)]
            if fresh[0] < rank:  # a lower rank came up late: such a word is merged one step at a time
                odd[word_of[touched[fresh < rank]]] = True
            for r, where in groups:
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heapq.heappush(queue, r)
        left_in = np.flatnonzero(alive)
        tokens, cuts = token[left_in].tolist(), np.searchsorted(left_in, np.append(0, ends)).tolist()
        out = [tokens[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.flatnonzero(odd):
            out[k] = self.merge_one(words[k])
        return out


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


class Codec:
    """Encodes the texts of a task; ``words`` maps a word to its place in the growing id store."""

    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS) -> None:
        self.ranks, self.find, self.limit = ranks_of(path), regex.compile(pattern).findall, cache_words
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.shown: list[str] = []

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """For every text the places of its words; ``ids_of`` and ``shown_of`` turn them into ids."""
        if len(self.words) > self.limit:
            self.forget()
        words, places = self.words, []
        known = len(words)
        for text in texts:
            places.append(np.array([words.setdefault(w, len(words)) for w in self.find(text)], np.int32))
        if len(words) > known:
            fresh = [w.encode() for w in list(words)[known:]]
            whole = [self.ranks.ids.get(w) for w in fresh]
            merged = iter(self.ranks.replay([w for w, one in zip(fresh, whole) if one is None]))
            ids = [next(merged) if one is None else [one] for one in whole]
            self.shown += [" ".join(map(str, x)) for x in ids]
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int64))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids]))
        return places

    def ids_of(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at ``places``, one after the other."""
        at = places.astype(np.int64)
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def shown_of(self, places: np.ndarray) -> str:
        return " ".join([self.shown[p] for p in places.tolist()])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the token ``ids`` of every text, no special tokens.  The rank file must be on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        for piece in slices(batches, SLICE_BYTES):
            ids = [codec.ids_of(p) for p in codec.encode(piece.column("text").to_pylist())]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id`` and the ``decoded`` bytes of every row of ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(ranks_path)
        for batch in batches:
            found = [ranks.decode(np.array(x if x is not None else [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text, decode the ids, and return per row the count of ids and both digests.

    One pass, so ids never leave the task: ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and
    ``decoded_sha256`` (the decoded bytes), both in lowercase hex.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        for piece in slices(batches, SLICE_BYTES):
            counts, shown, decoded = [], [], []
            for places in codec.encode(piece.column("text").to_pylist()):
                ids = codec.ids_of(places)
                counts.append(len(ids))
                shown.append(hashlib.sha256(codec.shown_of(places).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.ranks.decode(ids)).hexdigest())
            columns = [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shown), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

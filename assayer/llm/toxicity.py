"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

Training reads a bounded sample of labelled rows, whole texts, in Spark tasks.  One half of it finds the words and word stems
that stand in many toxic texts, in many different contexts, and hardly ever in ordinary ones.  One dictionary is trained on
windows of ordinary texts, the other on toxic texts: on their stretches that hold such words, since all else in them is
ordinary text (trained on whole windows of toxic texts it tells the classes apart badly; see the README).  It is used behind the
ordinary one, so both know ordinary text alike.  Each window of six words (a new one every four words, over the whole text)
is compressed with both; where the toxic dictionary makes it shorter by some bytes, the window speaks for toxicity.  How many
windows pass which difference is turned into a probability by a logistic calibration on the other half of the sample.

The driver meets labels, word counts, at most ``MOST_SAMPLES`` windows or stretches per dictionary and a few dozen numbers per
calibration row, never texts.  Scoring is one pass over the texts without a shuffle.  Null text counts as empty; an empty text
has no window and gets the calibrated probability of that.  Repeated rows are scored alike; an id is learned from once.  Rows
whose score is exactly 0.5 are predicted toxic.  Without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import id_and_text, slices, text_bytes
from assayer.session import stored

WINDOW_WORDS, WINDOW_STEP = 6, 4
DICTIONARY_BYTES, TOXIC_BYTES = 4096, 2048
#: The bounded training sample: rows of each class, whole texts.  Half of it trains the dictionaries, the rest calibrates.
TOXIC_ROWS, ORDINARY_ROWS = 2400, 6000
#: Windows or stretches that a dictionary is trained on at most, and the bytes of one stretch.
MOST_SAMPLES, STRETCH_BYTES = 20_000, 4000
#: A toxic word stands in so large a share of toxic texts, and so many times rather there than elsewhere.
LEAST_SHARE, LEAST_RATIO, LEAST_TEXTS = 0.01, 20, 5
STEM_SHARE, STEM_RATIO = 0.01, 20
LEVELS = np.arange(1, 9)
#: Text that a training task works on at once.
SLICE_BYTES = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fold_texts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts folded to lower-case words, with one space before and after each; and the new text ends."""
    lengths = np.diff(ends)
    fresh = np.cumsum(lengths + 2)
    out = np.full(int(fresh[-1]) if len(fresh) else 0, 32, np.uint8)
    folded = _FOLD[data]
    for a, b, to in zip(ends.tolist(), ends[1:].tolist(), (fresh - 1).tolist()):
        out[to - (b - a) : to] = folded[a:b]
    return out, np.append(0, fresh)


def windows(folded: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of every window, and the text it is in."""
    space = folded == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    of = np.searchsorted(ends, starts, side="right") - 1
    first = np.searchsorted(starts, ends)  # the first word of each text
    place = np.arange(len(starts)) - first[of]
    chosen = np.flatnonzero(place % WINDOW_STEP == 0)
    after = chosen + WINDOW_WORDS
    inside = after < first[of[chosen] + 1]
    stop = np.where(inside, starts[np.minimum(after, len(starts) - 1)] + 1, ends[of[chosen] + 1]) if len(starts) else after
    return np.stack([starts[chosen], stop - starts[chosen]], axis=1), of[chosen]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=13, chain_log=13, strategy=zstandard.STRATEGY_LAZY2, min_match=5, search_log=4,
        write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=settings)


def _sizes(compressor: zstandard.ZstdCompressor, folded: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0, np.int64)
    out = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(folded.tobytes(), at.astype(np.uint64).tobytes()))
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def features(differences: np.ndarray, of: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text: the largest difference, and how many windows (and which share) pass each level."""
    windows_of = np.bincount(of, minlength=n_texts)
    passed = np.stack([np.bincount(of[differences >= k], minlength=n_texts) for k in LEVELS], axis=1).astype(float)
    largest = np.zeros(n_texts)
    np.maximum.at(largest, of, differences)
    least_one = np.maximum(windows_of, 1)[:, None]
    return np.column_stack(
        [np.minimum(largest, 10) / 4, passed[:, 2:7] > 0, np.log1p(passed), np.sqrt(passed / least_one), np.log(least_one)]
    )


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def measure(self, data: np.ndarray, ends: np.ndarray, compressors) -> np.ndarray:
        folded, ends = fold_texts(data, ends)
        at, of = windows(folded, ends)
        return features(_sizes(compressors[0], folded, at) - _sizes(compressors[1], folded, at), of, len(ends) - 1)

    def compressors(self):
        return _compressor(self.ordinary), _compressor(self.toxic)

    def probability(self, measured: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(measured)), (measured - self.mean) / self.scale]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


def _contexts(text: bytes, neighbours: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a folded text and, with ``neighbours``, each word (by place) with each checksum of the words beside it."""
    words, known = text.split(), {}
    which = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if not neighbours:
        return list(known), which[:0], which[:0]
    beside = (zlib.crc32(before + b" " + after) for before, after in zip(chain([b""], words), chain(words[1:], [b""])))
    pairs = np.unique(which << 32 | np.fromiter(beside, np.int64, len(words)))
    return list(known), pairs >> 32, pairs & 0xFFFFFFFF


def _counts(texts: list[bytes], neighbours: bool) -> dict[bytes, int]:
    """For each word the texts it is in or, if fewer, its different contexts (few in copied passages)."""
    texts_with, contexts = Counter(), set()
    for text in texts:
        words, which, beside = _contexts(text, neighbours)
        texts_with.update(words)
        contexts |= {(words[w], c) for w, c in zip(which.tolist(), beside.tolist())}
    if not neighbours:
        return dict(texts_with)
    apart = Counter(word for word, _ in contexts)
    return {w: min(n, apart[w]) for w, n in texts_with.items()}


def contrast(here: dict[bytes, int], there: dict[bytes, int], n: int, m: int) -> list[bytes]:
    """Words, then word stems, of toxic texts; the most widely spread last, where a match costs least.

    ``here``: counts of words in ``n`` toxic texts, ``there``: in ``m`` ordinary ones.
    """

    def chosen(have: dict[bytes, int], other: dict[bytes, int], share: float, ratio: float) -> dict[bytes, int]:
        least = max(LEAST_TEXTS, share * n)
        return {w: v for w, v in have.items() if v >= least and v / n >= ratio * (other.get(w, 0) + 1) / m}

    words = chosen(here, there, LEAST_SHARE, LEAST_RATIO)

    def stems_of(words: dict[bytes, int]) -> dict[bytes, int]:
        out: dict[bytes, int] = defaultdict(int)
        for word, v in words.items():
            if v > 1:
                for k in range(4, min(len(word) + 1, 12) + 1):
                    out[(word + b" ")[:k]] += v
        return out

    here, there = stems_of(here), stems_of(there)
    good = chosen(here, there, STEM_SHARE, STEM_RATIO)
    stems = {}
    for stem in sorted(good, key=len):
        if not any(stem[:k] in good for k in range(4, len(stem))):
            longer = stem
            while more := [s for s in (longer + bytes([c]) for c in range(256)) if here.get(s, 0) >= 0.9 * here[longer]]:
                longer = more[0]
            stems[longer] = here[longer]
    return sorted(words, key=lambda w: (words[w], w)) + sorted(stems, key=lambda s: (stems[s], s))


def stretches(text: bytes, words: list[bytes]) -> list[bytes]:
    """The places of a folded text where one of ``words`` begins a word, joined to pieces of some thousand bytes."""
    if not words:
        return []
    some = re.compile(b"|".join(re.escape(b" " + w.strip()) for w in sorted(words, key=lambda w: (-len(w), w))))
    out, held = [], b""
    for match in some.finditer(text):
        held += match.group()
        if len(held) >= STRETCH_BYTES:
            out.append(held)
            held = b""
    return [*out, held] if held else out


def _trained(size: int, samples: list[bytes], **settings) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, **settings).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-size:].rjust(8, b" ")


def _untuned(windows_of_ordinary: list[bytes], stretches_of_toxic: list[bytes]) -> Model:
    base = _trained(DICTIONARY_BYTES, windows_of_ordinary)
    toxic = _trained(TOXIC_BYTES, stretches_of_toxic, k=64, d=8)
    return Model(base, base + toxic + b" ", np.zeros(0), np.zeros(0), np.zeros(0))


def _calibrated(model: Model, x: np.ndarray, y: np.ndarray, odds: float | None) -> Model:
    """``odds``: toxic to ordinary rows among all labels; the sample holds more toxic rows."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weights, ridge = np.zeros(z.shape[1]), np.append(1e-6, np.full(x.shape[1], 3.0))
    for _ in range(30):  # Newton steps of a ridge-penalised logistic fit
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        weights = weights + np.linalg.solve(hessian, z.T @ (y - p) - ridge * weights)
    if odds:
        weights[0] += np.log(odds) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(model.ordinary, model.toxic, mean, scale, weights)


def _window_bytes(folded: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = folded.tobytes()
    return [raw[x : x + n] for x, n in windows(folded, ends)[0].tolist()]


def fit(texts: list[str], labels: list[int], odds: float | None = None) -> Model | None:
    """Train on texts in memory, as :func:`train` does on a sample in tasks; None without both classes."""
    halves = {k: [t for t, l in zip(texts, labels) if l == k] for k in (0, 1)}
    if not halves[0] or not halves[1]:
        return None
    first = {k: h[::2] for k, h in halves.items()}
    rest = {k: h[1::2] or h for k, h in halves.items()}
    folded = {k: [fold_texts(*_joined([t]))[0].tobytes() for t in h] for k, h in first.items()}
    words = contrast(_counts(folded[1], True), _counts(folded[0], False), len(folded[1]), len(folded[0]))
    some = _window_bytes(*fold_texts(*_joined(first[0])))
    some = sorted(some, key=zlib.crc32)[:MOST_SAMPLES]
    plain = _untuned(some, [s for t in folded[1] for s in stretches(t, words)][:MOST_SAMPLES])
    x = plain.measure(*_joined(rest[1] + rest[0]), plain.compressors())
    return _calibrated(plain, x, np.repeat([1.0, 0.0], [len(rest[1]), len(rest[0])]), odds)


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """The stored sample ``text, toxic, half`` (0 trains, 1 calibrates, 2 both) and how many labelled rows each class has.

    It is picked from the narrow label table by a hash of the id; only ids and labels meet the driver.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = []
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        ids = known.filter(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most).collect()
        picked += [(r["doc_id"], label, k % 2 if len(ids) > 1 else 2) for k, r in enumerate(ids)]
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int, half int"))
    rows = id_and_text(docs).join(chosen, "doc_id").groupBy("doc_id", "toxic", "half").agg(F.min("text").alias("text"))
    return stored(rows.select("text", "toxic", "half"), "toxicity-sample"), n


def word_counts(sample: DataFrame) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """What :func:`_counts` says of the toxic and of the ordinary texts, for words that stand in several texts of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            folded, ends = fold_texts(*text_bytes(piece.column("text")))
            for a, b, toxic in zip(ends.tolist(), ends[1:].tolist(), piece.column("toxic").to_pylist()):
                words, which, beside = _contexts(folded[a:b].tobytes(), bool(toxic))
                words = pa.array(words, pa.binary())
                rows = len(words) + len(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, toxic, np.int32)), pa.concat_arrays([words, words.take(pa.array(which))]),
                        pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(beside)]),
                    ],
                    ["toxic", "word", "context"],
                )

    found = stored(sample.mapInArrow(run, "toxic int, word binary, context long"), "toxicity-words")
    texts = found.filter("context IS NULL").groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("here"), F.count_if(F.col("toxic") == 0).alias("there"))
    apart = found.filter("context IS NOT NULL").select("word", "context").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("apart"))
    both = texts.join(apart, "word", "left").select("word", F.least("here", F.coalesce("apart", F.lit(0))).alias("here"), "there")
    rows = both.filter("here > 1 OR there > 1").collect()
    return {bytes(r["word"]): r["here"] for r in rows if r["here"]}, {bytes(r["word"]): r["there"] for r in rows if r["there"]}


def _some(sample: DataFrame, pieces: Callable[[np.ndarray, np.ndarray], list[bytes]]) -> list[bytes]:
    """At most ``MOST_SAMPLES`` of the byte strings that ``pieces`` makes of folded texts, the first by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            found = pieces(*fold_texts(*text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["piece"])

    found = sample.select("text").mapInArrow(run, "piece binary")
    return [bytes(r["piece"]) for r in found.orderBy(F.crc32("piece"), "piece").limit(MOST_SAMPLES).collect()]


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model | None:
    """Fit on a bounded sample of the labelled rows that are not held out; None without both classes."""
    sample, n = training_rows(docs, labels, toxic_rows, ordinary_rows)
    first, rest = sample.filter("half != 1"), sample.filter("half != 0")
    sizes = {r["toxic"]: r["count"] for r in first.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    words = contrast(*word_counts(first), sizes[1], sizes[0])

    def cut(folded: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = folded.tobytes()
        return [s for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()) for s in stretches(raw[a:b], words)]

    plain = _untuned(_some(first.filter("toxic = 0"), _window_bytes), _some(first.filter("toxic = 1"), cut))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = plain.compressors()
        for batch in slices(batches, SLICE_BYTES):
            x = plain.measure(*text_bytes(batch.column("text")), compressors)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = rest.select("text", "toxic").mapInArrow(measured, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if not len(rows) or not 0 < y.sum() < len(rows):  # a class whose texts are all missing
        return None
    return _calibrated(plain, np.array([r["x"] for r in rows]), y, n[1] / n[0])


def _scores(model: Model | None, batch: pa.RecordBatch, compressors) -> np.ndarray:
    if model is None:
        return np.zeros(batch.num_rows)
    return model.probability(model.measure(*text_bytes(batch.column("text")), compressors))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model else None
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(_scores(model, piece, compressors))], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_ordinary(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model else None
        for batch in batches:
            texts = batch.column("text").fill_null("") if batch.num_rows else batch.column("text")
            only_text = pa.RecordBatch.from_arrays([texts], ["text"])
            parts = [_scores(model, p, compressors) for p in slices(iter([only_text]))]
            yield batch.filter(pa.array(np.concatenate(parts) < 0.5)) if parts else batch

    return docs.mapInArrow(run, docs.schema)

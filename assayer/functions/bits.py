"""Hashed fingerprints and bit similarity as native expressions.

A fingerprint is the sorted ``array<int>`` of its set bits; narrow ones can also be
packed into 64-bit words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.common import give_back, let

# fixed value: fingerprint length
N_BITS = 2048


def char_grams(text: Column, n: int = 3) -> Column:
    """Overlapping character n-grams in one pattern pass; a shorter text is its own single gram."""
    overlapping = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(text) < n, F.array(text)).otherwise(overlapping)


def word_grams(text: Column, n: int = 1) -> Column:
    """Word n-grams over white space; a shorter text is its own single gram."""
    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))
    words = F.split(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), " ")
    return words if n == 1 else let(words, windows)


def gram_bit(gram: Column, n_bits: int = N_BITS) -> Column:
    """A gram's bit: the first 32 bits of its md5, modulo the length."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long"), F.lit(n_bits)).cast("int")


def fingerprint(grams: Column, n_bits: int = N_BITS) -> Column:
    """Sorted distinct bits of a gram array; an empty text has no bits, NULL stays NULL."""
    used = F.filter(F.array_distinct(grams), lambda g: g != "")
    return F.array_sort(F.array_distinct(F.transform(used, lambda g: gram_bit(g, n_bits))))


# a worker numbers the characters it meets; grams of all but the last number are looked up by place, others (so many at most) by name
_ALPHABET, _KEPT = 256, 1 << 18
_numbers = np.zeros(0, np.int32)
_bits_of: dict[int, tuple[np.ndarray, dict[str, int]]] = {}


def _md5_bit(gram: str, n_bits: int) -> int:
    return int(hashlib.md5(gram.encode(errors="replace")).hexdigest()[:8], 16) % n_bits


def _numbered(codes: np.ndarray) -> np.ndarray:
    """Numbers of characters, given as they are first met; the last number stands for all that come too late for one."""
    global _numbers
    if not len(_numbers):
        _numbers = np.full(0x110000, -1, np.int32)
    found = _numbers[codes]
    if found.min() < 0:
        given = int(_numbers.max()) + 1
        for c in np.unique(codes[found < 0]).tolist():
            _numbers[c] = min(given, _ALPHABET - 1)
            given += 1
        found = _numbers[codes]
    return found


def _text_bits(text: str, n_bits: int) -> np.ndarray:
    """Sorted bits of a text's 3-grams, the same as ``fingerprint(char_grams(text), n_bits)``."""
    if len(text) < 3:
        return np.array([_md5_bit(text, n_bits)] if text else [], np.int32)
    if n_bits not in _bits_of:
        _bits_of[n_bits] = (np.zeros(_ALPHABET**3, np.int32), {})
    known, others = _bits_of[n_bits]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    number = _numbered(codes)
    place = (number[:-2] * _ALPHABET + number[1:-1]) * _ALPHABET + number[2:]
    # bits count from 1 here: what was never set is 0, and takes no memory
    found = known[place]
    marks = np.zeros(n_bits + 1, bool)
    new = np.flatnonzero(found == 0)
    marks[found] = True
    rare = {text[i : i + 3] for i in new.tolist()}
    if codes.max() > 0xFFFF:
        # the pattern also stops inside a character of two UTF-16 units, which then reads as "?"
        rare.update(f"?{text[i + 1 : i + 3]}" for i in np.flatnonzero(codes[:-2] > 0xFFFF).tolist())
    if len(others) > _KEPT:
        others.clear()
    for gram in rare:
        if gram not in others:
            a, b, c = _numbered(np.array([ord(x) for x in gram])).tolist()
            bit = _md5_bit(gram, n_bits) + 1
            if max(a, b, c) < _ALPHABET - 1:
                known[(a * _ALPHABET + b) * _ALPHABET + c] = bit
                marks[bit] = True
                continue
            others[gram] = bit
        marks[others[gram]] = True
    return np.flatnonzero(marks[1:]).astype(np.int32)


def text_fingerprint(text: Column, n_bits: int = N_BITS) -> Column:
    """``fingerprint(char_grams(text), n_bits)`` without a list of grams per row: each gram is hashed once per worker."""

    @F.arrow_udf("array<int>")
    def bits(texts: pa.Array) -> pa.Array:
        found = [_text_bits(t.as_py(), n_bits) if t.is_valid else np.zeros(0, np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *found])), mask=texts.is_null())
        give_back()
        return lists

    return bits(text)


def sign_bits(values: Column, width: int) -> Column:
    """Positions (from 0) whose value is above zero."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(values, i) > 0)


def pack_words(bits: Column, n_words: int) -> Column:
    """Set bits as 64-bit words; for narrow fingerprints (work is words times bits)."""
    def word(w):
        return F.aggregate(
            F.filter(bits, lambda b: F.floor(b / 64) == w),
            F.lit(0).cast("long"),
            lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)))),
        )
    return F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), word)


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over united bits; two empty fingerprints have similarity 0."""
    total = F.size(a) + F.size(b)
    return let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.when(total == 0, F.lit(0.0)).otherwise(both / F.nullif(total - both, F.lit(0))),
    )


def tanimoto_words(a: Column, b: Column) -> Column:
    both = _ones(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = _ones(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / F.nullif(either, F.lit(0)))


def hamming_words(a: Column, b: Column) -> Column:
    return _ones(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))

"""Vectorised word and shingle hashing over Arrow batches of UTF-8 text.

The functions work on the bytes of many documents at once.  A word hash is a polynomial
over the lower-cased bytes, taken as a difference of prefix sums, so that no word is ever a
Python object.  All arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C55)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEP = U(0xD1342543DE82EF95)
#: Bytes that are handled at a time; a longer document is handled alone.
SLICE_BYTES = 1 << 20

_code = np.arange(256, dtype=np.uint8)
LOWER = np.where((_code >= 65) & (_code <= 90), _code + 32, _code).astype(np.uint8)
IS_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)
_powers = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        out = np.full(max(n, SLICE_BYTES), base, U)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=U)
    return _powers[base][:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its length in bytes, and for each document where its words begin
    (one entry more than there are documents)."""
    size = len(data)
    if not size:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    fresh = np.zeros(size + 1, bool)
    fresh[offsets] = True  # a document's first byte never continues a word
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    prefix = np.zeros(size + 1, U)
    np.cumsum(LOWER[data].astype(U) * powers(BASE, size), out=prefix[1:], dtype=U)
    length = ends - starts
    hashes = mix((prefix[ends] - prefix[starts]) * powers(INVERSE, size)[starts] + length.astype(U) * STEP)
    return hashes, length, np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a run must be checked against its document's end."""
    if len(hashes) < k:
        return np.zeros(0, U)
    out = np.zeros(len(hashes) - k + 1, U)
    factor = 1
    for j in range(k):
        out += hashes[j : j + len(out)] * U(factor)
        factor = factor * int(STEP) % (1 << 64)
    return mix(out)

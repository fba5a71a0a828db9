"""Vectorised tokenising and hashing of Arrow text batches: whole texts, no per-word Python."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from jetloom.llm.staging import split_mix

#: Bytes of text worked on at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Tokens of more bytes are hashed by blake2b: the polynomial sum modulo 2^64 is equal for some long texts made for it.
LONG_TOKEN = 32

#: ASCII white space of the contracts: space and U+0009 to U+000D.
SPACE_REGEX = r"[\x20\x09-\x0D]+"
WORD_REGEX = r"[^\x20\x09-\x0D]+"

_POLY = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD1B54A32D192ED03 | 1


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _punctuation_table() -> np.ndarray:
    table = np.ones(256, bool)
    table[128:] = False
    for first, last in ("09", "AZ", "az"):
        table[ord(first) : ord(last) + 1] = False
    return table


IS_SPACE = _space_table()
#: Everything but ASCII letters, digits and non-ASCII bytes.
IS_PUNCTUATION = _punctuation_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _POLY, np.uint64)
    down = np.full(n + 1, pow(_POLY, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd 64-bit base and of its inverse."""
    size = 1 << max(20, int(n).bit_length())
    return _powers(size)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop
        row = stop


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sum; ``range_hash`` of any byte range follows from two entries."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[start, end)``."""
    _, down = powers(len(prefix))
    raw = (prefix[end] - prefix[start]) * down[start]
    return split_mix(raw + (end - start).astype(np.uint64) * np.uint64(_GRAM))


@dataclass
class Words:
    """Tokens of a run of documents: hash, byte range and the first token of every document."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # per document, n_docs + 1 entries

    def of(self, doc: int) -> np.ndarray:
        return self.hashes[self.first[doc] : self.first[doc + 1]]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = IS_SPACE) -> Words:
    """Split the documents ``data[offsets[i]:offsets[i+1]]`` at ``breaks`` and hash every token."""
    base = offsets - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~breaks[data]
    doc_start = np.zeros(len(data) + 1, bool)
    doc_start[base] = True
    cut = doc_start[: len(data)] if len(data) else np.zeros(0, bool)
    now, before, after = inside[1:-1], inside[:-2], inside[2:]
    start = np.flatnonzero(now & (~before | cut))
    end = np.flatnonzero(now & (~after | doc_start[1:])) + 1
    hashes = range_hash(prefix_hash(data), start, end)
    long = np.flatnonzero(end - start > LONG_TOKEN)
    if len(long):
        digests = (hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest() for a, b in zip(start[long], end[long], strict=True))
        hashes[long] = np.frombuffer(b"".join(digests), "<u8")
    return Words(hashes, start, end, np.searchsorted(start, base))


def gram_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` tokens; fewer tokens than that make one run of all of them."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < width:
        powers_ = np.cumprod(np.full(n, _GRAM, np.uint64))
        return split_mix(np.array([(tokens * powers_).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = np.zeros(n - width + 1, np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * _GRAM % (1 << 64)
        total += tokens[k : n - width + 1 + k] * np.uint64(factor)
    return split_mix(total + np.uint64(width))


def distinct_shingles(words: Words, doc: int, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document."""
    grams = np.sort(gram_hashes(words.of(doc), width))
    if len(grams) > 1:
        keep = np.empty(len(grams), bool)
        keep[0] = True
        np.not_equal(grams[1:], grams[:-1], out=keep[1:])
        grams = grams[keep]
    return grams

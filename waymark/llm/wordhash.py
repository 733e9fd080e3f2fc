"""Words of a batch of texts as arrays of numbers.

Words are maximal runs of bytes other than blank and 0x09-0x0D; in UTF-8 those bytes never
occur inside another character, so bytes and characters give the same words. A word is named
by 64 bits, mixed from its bytes eight at a time. Everything is arithmetic over whole batches,
without a Python object per word.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 256  # bytes from which a word is hashed by itself
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[[i for i in range(128) if not chr(i).isalpha()]] = True


class Words(NamedTuple):
    hashes: np.ndarray  # a number per word
    doc: np.ndarray  # index of the text each word is in
    start: np.ndarray  # byte offsets in ``data``
    end: np.ndarray
    data: np.ndarray  # bytes of all texts
    counts: np.ndarray  # words per text
    offsets: np.ndarray  # byte offset of each text, and the end
    padded: np.ndarray  # ``data`` and eight bytes more


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x + _U((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)
    x ^= x >> _U(30)  # in place: these arrays are as long as all words at hand
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _eight(padded: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as a number; bytes from ``sizes`` on count as 0."""
    view = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))
    out = view[at]
    short = sizes < 8
    out[short] &= (_U(1) << (sizes[short].astype(np.uint64) * _U(8))) - _U(1)
    return out


def _first(padded: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(_eight(padded, at, sizes), 3)


def _hashes(data: np.ndarray, padded: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = _first(padded, start, lengths)
    rest = np.flatnonzero((lengths > 8) & (lengths < _LONG))
    done = 8
    while len(rest):
        out[rest] = mix(out[rest] ^ _eight(padded, start[rest] + done, lengths[rest] - done), 4)
        done += 8
        rest = rest[lengths[rest] > done]
    for i in np.flatnonzero(lengths >= _LONG):
        raw = data[start[i] : start[i] + lengths[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return mix(out + lengths.astype(np.uint64))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of texts; NULL counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, fold: bool = False, letters: bool = False) -> Words:
    """All words of the texts in order. ``fold`` reads A-Z as a-z; ``letters`` parts words at
    every ASCII character that is no letter."""
    data, offsets = text_buffers(texts)
    inside = ~(_NO_LETTER if letters else _SPACE)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # a text's end closes its last word, its start opens the first
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    if len(edges):
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    del inside, first, last
    padded = np.concatenate([_LOWER[data] if fold else data, np.zeros(8, np.uint8)])
    hashes = _hashes(padded[:-8], padded, start, end - start)
    counts = np.diff(np.searchsorted(start, offsets))
    return Words(hashes, np.repeat(np.arange(len(counts)), counts), start, end, data, counts, offsets, padded)


def beginnings(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` (at most 8) bytes of all longer words, as of a word of those bytes, and the words' indexes."""
    at = np.flatnonzero(w.end - w.start > size)
    sizes = np.full(len(at), size)
    return mix(_first(w.padded, w.start[at], sizes) + _U(size)), at


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within one text, and the index of their first word."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= _BASE
        out += w.hashes[k : k + n]
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    return mix(out[at], size), at


def hash_of(word: str) -> int:
    return int(words(pa.array([word]), fold=True, letters=True).hashes[0])


def slices(table: pa.Table | pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Pieces of a batch whose texts hold about ``limit`` bytes; a longer text stands alone."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(table.column(column)), 0))
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        base = total[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield table.slice(first, stop - first)
        first = stop

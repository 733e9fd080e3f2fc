"""crc32 of many short byte strings at once, and of two strings joined."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

_POLYNOMIAL = 0xEDB88320
_SHORT = 64  # bytes up to which strings are joined by tables


@cache
def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


@cache
def _moved(n: int) -> np.ndarray:
    """Four tables, by byte, of what a checksum becomes when ``n`` zero bytes follow it."""
    table, by_byte = _table(), np.arange(256, dtype=np.uint32)
    state = np.stack([by_byte << np.uint32(8 * k) for k in range(4)])
    for _ in range(n):
        state = (state >> np.uint32(8)) ^ table[state & np.uint32(0xFF)]
    return state


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Checksums of ``data[start:end]`` for each pair, all strings one byte further at a time."""
    table, lengths = _table(), end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(lengths <= _SHORT)
    done = 0
    while len(short := short[lengths[short] > done]):
        out[short] = (out[short] >> np.uint32(8)) ^ table[(out[short] ^ data[start[short] + done]) & np.uint32(0xFF)]
        done += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def joined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of two strings written together, from those of both and the bytes of the second."""
    out = np.empty(len(first), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        at, n = order[a:b], int(lengths[order[a]])
        t = _moved(n) if n <= _SHORT else _moved_far(n)
        c = first[at]
        byte = [(c >> np.uint32(8 * k)) & np.uint32(0xFF) for k in range(4)]
        out[at] = t[0][byte[0]] ^ t[1][byte[1]] ^ t[2][byte[2]] ^ t[3][byte[3]]
    return out ^ second


def _moved_far(n: int) -> np.ndarray:
    """As :func:`_moved` for any number of bytes, by doubling; not kept."""
    state, step = _moved(0), _moved(1)
    while n:
        if n & 1:
            state = _through(step, state)
        step, n = _through(step, step), n >> 1
    return state


def _through(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = np.zeros_like(state)
    for k in range(4):
        out ^= tables[k][(state >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out

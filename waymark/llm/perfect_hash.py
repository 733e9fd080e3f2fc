"""A minimal perfect hash of digests, and lookups that are checked byte by byte.

Levels of bit maps: each level hashes the digests left to twice as many bits as there are; a digest
alone on its bit is placed, the others go on. The number of set bits before a digest's own is its slot,
so n digests fill n slots. Any other digest finds some slot or none; the digest stored there tells.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from waymark.llm.wordhash import mix

BYTES = 32
_BITS_PER_KEY = 2
_U = np.uint64


class PerfectHash(NamedTuple):
    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # those of all levels, one bool each
    before: np.ndarray  # set bits before each bit


def as_words(digests: list[bytes]) -> np.ndarray:
    """Digests of 32 bytes as rows of four numbers."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, BYTES // 8)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    out = np.zeros(len(keys), _U)
    for column in keys.T:
        out = mix(out ^ column, 100 + level)
    return (out % _U(size)).astype(np.int64)


def build(keys: np.ndarray) -> PerfectHash:
    """For distinct keys (rows of four numbers)."""
    sizes, maps, left, level = [], [], keys, 0
    while len(left):
        size = _BITS_PER_KEY * len(left) + 1
        at = _places(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        maps.append(alone)
        left = left[~alone[at]]
        level += 1
    return restored(np.array(sizes, np.int64), np.concatenate(maps) if maps else np.zeros(0, bool))


def restored(sizes: np.ndarray, bits: np.ndarray) -> PerfectHash:
    return PerfectHash(sizes, bits, np.cumsum(bits) - bits)


def slots(h: PerfectHash, keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level has it."""
    out, waiting, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(h.sizes.tolist()):
        at = start + _places(keys[waiting], level, size)
        here = h.bits[at]
        out[waiting[here]] = h.before[at[here]]
        waiting, start = waiting[~here], start + size
    return out


def found(h: PerfectHash, held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot of each key that is held there byte by byte; -1 for keys that are not members."""
    out = slots(h, keys)
    some = np.flatnonzero(out >= 0)
    out[some[(held[out[some]] != keys[some]).any(axis=1)]] = -1
    return out

"""Words of texts as hashes, without a Python object per word.

A word is a run of bytes other than \\x20 and \\x09 to \\x0D. Its hash is a polynomial over a random
value for each byte, taken as a difference of running sums over the whole chunk and then mixed.
"""

from __future__ import annotations

import functools

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes hashed at once. Longer inputs are cut at white space.
PIECE = 1 << 18
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(8)
def _values(seed: int, lower: bool) -> np.ndarray:
    """A value for each byte; white space has none, and with ``lower`` A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD[seed]))
    if lower:
        v[65:91] = v[97:123]
    v[list(SPACES)] = 0
    return v


@functools.lru_cache(4)
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, ODD[seed], np.uint64), np.full(n, pow(ODD[seed], -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the polynomial's base and of its inverse modulo 2 ** 64."""
    return _powers(seed, 1 << max(16, int(n).bit_length()))


SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last one."""
    word = ~SPACE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    return edge[::2], edge[1::2]


def hashes(texts: list[bytes], lower: bool = False, seeds: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """For each seed the hash of every word of every text, and the offsets of the texts' words."""
    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in seeds]
    firsts, at = [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):  # cut at white space; a longer word stays whole
            blanks = np.flatnonzero(SPACE[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                blanks = np.flatnonzero(SPACE[data[end:]])
                end = end + int(blanks[0]) + 1 if len(blanks) else len(data)
        piece = data[at:end]
        a, b = bounds(piece)
        for seed, out in zip(seeds, found):
            up, down = powers(seed, len(piece))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_values(seed, lower)[piece] * up[: len(piece)], out=sums[1:])
            out.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(ODD[1 - seed])))
        firsts.append(a + at)
        at = end
    first = np.concatenate(firsts)
    return [np.concatenate(x) for x in found], np.searchsorted(first, np.append(starts, len(data) + 1))

"""Golomb-Rice coding of sorted 64-bit integers with NumPy: unary quotients and binary
remainders are kept as two bit strings, so both directions are array operations. Long lists are
coded in blocks, which bounds the memory."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<IBIQ")  # count, remainder bits, unary bits, first value
BLOCK = 1 << 18


def encode(values: np.ndarray) -> bytes:
    """``values``: ascending uint64."""
    return b"".join(_block(values[a : a + BLOCK]) for a in range(0, len(values), BLOCK))


def _block(values: np.ndarray) -> bytes:
    n = len(values)
    gaps = np.diff(values)
    mean = float(gaps.mean()) if n > 1 else 0.0
    k = min(56, max(0, int(np.log2(max(mean, 1.0)))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + n - 1, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    # the last k of 64 bits, most significant first
    rest = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - (k + 7) // 8 :], axis=1)[:, (-k) % 8 :] if k else np.zeros(0, np.uint8)
    return HEAD.pack(n, k, len(unary), int(values[0])) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(blob: bytes) -> np.ndarray:
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(blob):
        n, k, n_unary, first = HEAD.unpack_from(blob, at)
        at += HEAD.size
        unary = np.unpackbits(np.frombuffer(blob, np.uint8, (n_unary + 7) // 8, at), count=n_unary)
        at += (n_unary + 7) // 8
        gaps = (np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
        n_rest = (k * (n - 1) + 7) // 8
        if k:
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, n_rest, at), count=k * (n - 1)).reshape(n - 1, k)
            whole = np.zeros((n - 1, 64), np.uint8)
            whole[:, 64 - k :] = bits
            gaps |= np.packbits(whole, axis=1).view(">u8").ravel().astype(np.uint64)
        at += n_rest
        out.append(np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)]))
    return np.concatenate(out)

"""XXH64 of many byte spans at once, in numpy.

The published algorithm, step by step over all spans that still have bytes left
for that step.  Spans longer than ``LONG`` bytes go to the C library one by one.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 1 << 12
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_1, _2, _3, _4, _5 = (np.uint64(p) for p in (P1, P2, P3, P4, P5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _2, 31) * _1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of ``data[start:end]`` (bytes) for each pair."""
    size = end - start
    # eight bytes from every byte on
    padded = np.concatenate([data, np.zeros(16 - len(data) % 8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view("<u8"), (len(data) + 1,), (1,))
    lanes = eight.take
    mask = (1 << 64) - 1
    with np.errstate(over="ignore"):
        out = np.full(len(start), (seed + P5) & mask, np.uint64)
        at = start.copy()
        some = np.flatnonzero((size >= 32) & (size <= LONG))
        if len(some):
            some = some[np.argsort(-(size[some] >> 5), kind="stable")]
            stripes = size[some] >> 5
            acc = [np.full(len(some), x & mask, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            for k in range(int(stripes[0])):
                m = int(np.searchsorted(-stripes, -k))  # those with more than k stripes come first
                here = at[some[:m]] + 32 * k
                for j in range(4):
                    acc[j][:m] = _round(acc[j][:m], lanes(here + 8 * j))
            h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.zeros_like(a), a)) * _1 + _4
            out[some] = h
            at[some] += 32 * stripes
        out += size.astype(np.uint64)
        left = end - at
        for _ in range(3):
            m = np.flatnonzero((left >= 8) & (size <= LONG))
            if len(m):
                out[m] = _turn(out[m] ^ _round(np.zeros(len(m), np.uint64), lanes(at[m])), 27) * _1 + _4
                at[m] += 8
                left[m] -= 8
        m = np.flatnonzero((left >= 4) & (size <= LONG))
        if len(m):
            out[m] = _turn(out[m] ^ (lanes(at[m]) & np.uint64(0xFFFFFFFF)) * _1, 23) * _2 + _3
            at[m] += 4
            left[m] -= 4
        for _ in range(3):
            m = np.flatnonzero((left >= 1) & (size <= LONG))
            if len(m):
                out[m] = _turn(out[m] ^ padded[at[m]].astype(np.uint64) * _5, 11) * _1
                at[m] += 1
                left[m] -= 1
        out = (out ^ (out >> np.uint64(33))) * _2
        out = (out ^ (out >> np.uint64(29))) * _3
        out ^= out >> np.uint64(32)
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out

"""Words, windows and hashes of text columns, vectorised over whole Arrow arrays.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` in the
UTF-8 text.  Nothing here loops over documents or words in Python.  Hashes have
64 bits: two different windows among N get equal ones with odds of N * N / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_B = 0x9E3779B97F4A7C15  # odd multiplier of the window polynomial


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.diff(_buffers(batch.column(column))[1]))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    if off is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """The words of an array of texts.

    ``data``/``offsets``: bytes of all texts; ``start``/``end``: bytes of each
    word; ``first``: for each text the index of its first word, and the total.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = _buffers(texts)
        if lower:
            up = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (up.astype(np.uint8) << 5)
        self.n = len(self.offsets) - 1
        size = len(self.data)
        self.solid = solid = ~_SPACE[self.data]
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(size, bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(size, bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every slice and process."""
        return spans(self.data, self.start, self.end)

    def starts_of(self, n: int) -> np.ndarray:
        """Indices of the words at which a window of ``n`` words of one text starts."""
        return whole(self.first, n)


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of ``n`` items that stay within one group; ``first`` bounds the groups."""
    keep = np.zeros(first[-1] + 1, np.int8)
    long = np.diff(first) >= n
    np.add.at(keep, first[:-1][long], 1)
    np.add.at(keep, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(keep[:-1]))


_BYTE = np.random.default_rng(0x5EED).integers(0, 1 << 64, 256, np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_B, pow(_B, -1, 1 << 64))):
            each = np.full(n, base, np.uint64)
            each[0] = 1
            _POWERS[k] = np.cumprod(each, dtype=np.uint64)
    return _POWERS


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, spans being in order and apart.

    A hash depends on its span alone, so a very long text is hashed in parts.
    """
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(start, start[k] + SLICE_BYTES)))
        low = start[k]
        out[k:to] = _spans(data[low : end[to - 1]], start[k:to] - low, end[k:to] - low)
        k = to
    return out


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same from prefix sums of one polynomial over all bytes."""
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` items from each position on, by doubling; shorter by ``n - 1``.

    The polynomial ``sum(h[i + j] * B**j)`` modulo 2**64 over 64-bit item
    hashes, finished by a mixing step.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    have, done, power, span = None, 0, h, 1
    m = n
    with np.errstate(over="ignore"):
        while m:
            if m & 1:
                part = power[done:]
                have = power.copy() if have is None else have[: len(part)] + _power(done) * part
                done += span
            m >>= 1
            if m:
                power = power[:-span] + _power(span) * power[span:]
                span *= 2
        return mix(have[: len(h) - n + 1])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` items lie in a window of ``n`` items that starts at one of ``starts``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, total), -1)
    return np.cumsum(edge[:-1]) > 0


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the items of each group."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]

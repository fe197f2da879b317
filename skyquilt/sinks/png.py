"""Thumbnails: reduced, stretched and encoded as 8-bit grey PNG in the task that holds the image."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def encode(a: np.ndarray) -> bytes:
    """Rows x columns of bytes as a PNG file."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = np.concatenate([np.zeros((len(a), 1), np.uint8), a.astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def thumbnail(a: np.ndarray, most: int = 512, target: float = 0.2) -> np.ndarray:
    """Area means of at most ``most`` pixels a side, stretched by median, deviation and midtones."""
    step = max(1, -(-max(a.shape) // most))
    ys, xs = np.arange(0, a.shape[0], step), np.arange(0, a.shape[1], step)
    sums = np.add.reduceat(np.add.reduceat(a.astype(float), ys, axis=0), xs, axis=1)
    small = sums / np.outer(np.diff(np.r_[ys, a.shape[0]]), np.diff(np.r_[xs, a.shape[1]]))
    v = np.sort(small.ravel()[:: max(1, small.size // 200_000)])
    median, white = v[len(v) // 2], v[min(len(v) - 1, int(len(v) * 0.9995))]
    mad = np.sort(np.abs(v - median))[len(v) // 2]
    black = max(v[0], median - 2.8 * mad)
    if white <= black:
        return np.zeros(small.shape, np.uint8)
    shown = np.clip((small - black) / (white - black), 0, 1)
    mid = (median - black) / (white - black)
    if 0 < mid < 1:
        m = mid * (1 - target) / (mid - 2 * target * mid + target)
        shown = (m - 1) * shown / ((2 * m - 1) * shown - m)
    return np.floor(shown * 255 + 0.5).astype(np.uint8)


def thumbnails(images: DataFrame, most: int = 512) -> DataFrame:
    """``path, png`` of decoded images."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "png": [encode(thumbnail(np.frombuffer(d, "<f4").reshape(h, w), most)) for w, h, d in zip(b["width"], b["height"], b["data"])]})

    return images.where("data is not null").select("path", "width", "height", "data").mapInPandas(make, "path string, png binary")

"""Four-star codes: frame coordinates, canonical order, quantization and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTUM = 65535


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def quantize_x(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(QUANTUM), half_up(v * QUANTUM))).cast("int")


def quantize_y(v: Column) -> Column:
    return quantize_x(v + 0.5)


def bin_of(q: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(q * bins / F.lit(float(QUANTUM + 1)))).cast("int")


def cell_of(codes: list[Column], bins: int) -> Column:
    cell = bin_of(codes[0], bins)
    for c in codes[1:]:
        cell = cell * bins + bin_of(c, bins)
    return cell


def frame(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The complex number (p - a) / (b - a)."""
    dx, dy, qx, qy = bx - ax, by - ay, px - ax, py - ay
    den = dx * dx + dy * dy
    return (qx * dx + qy * dy) / den, (qy * dx - qx * dy) / den


def in_circle(zr: Column, zi: Column) -> Column:
    return zr * zr + zi * zi - zr <= 0


def bins_for(quads: int) -> int:
    return max(16, min(64, int((0.6 * quads) ** 0.25 + 0.5)))


def wide_bins_for(quads: int) -> int:
    return max(2, min(64, int((quads / 4) ** 0.25)))

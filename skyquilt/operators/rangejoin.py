"""Range and nearest-neighbour joins in any number of dimensions.

A condition ``abs(l - r) <= tol`` alone plans as a nested loop.  Here each axis
is cut into bins of its tolerance; one side goes to its own cell, the other to
every cell its box touches, so the join is an equi-join on cells with the exact
test as a residual.  Spark picks the physical join and splits skewed cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """A column of the left, one of the right and the largest difference (a number, or a right column)."""

    left: str
    right: str
    tolerance: float | str
    #: bin width; the tolerance if that is a number
    width: float | None = None

    def bin_width(self) -> float:
        if self.width is not None:
            return self.width
        if isinstance(self.tolerance, str):
            raise ValueError("a tolerance by row needs a bin width")
        return float(self.tolerance)


def _cells(axes: Sequence[Axis]) -> tuple[list[Column], list[Column]]:
    own, touched = [], []
    for a in axes:
        w = F.lit(a.bin_width())
        tol = F.col(a.tolerance) if isinstance(a.tolerance, str) else F.lit(float(a.tolerance))
        own.append(F.floor(F.col(a.left) / w))
        touched.append(F.sequence(F.floor((F.col(a.right) - tol) / w), F.floor((F.col(a.right) + tol) / w)))
    return own, touched


def range_join(left: DataFrame, right: DataFrame, axes: Sequence[Axis], residual: Column, on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join rows whose box on all axes and ``residual`` agree, and whose columns ``on`` are equal.

    ``how``: inner, left, left_semi or left_anti.  Other columns of both sides must have distinct names.
    """
    own, touched = _cells(axes)
    keys = [f"__cell{k}" for k in range(len(axes))]
    l, r = left, right
    for k, o, t in zip(keys, own, touched):
        l, r = l.withColumn(k, o), r.withColumn(k, F.explode(t))
    both = [*on, *keys]
    names = {c: f"__r_{c}" for c in both}
    r = r.withColumnsRenamed(names)
    cond = residual
    for c in both:
        cond = (F.col(c) == F.col(names[c])) & cond
    return l.join(r, cond, how).drop(*keys, *names.values())


#: Fixed value: cells of :func:`nearest` in radii; the right rows go to (1 + 2 / WIDE) ** 2 cells on average.
WIDE = 4


def nearest(left: DataFrame, right: DataFrame, x: tuple[str, str], y: tuple[str, str], radius: float | str, key: str, tie: Sequence[str], on: Sequence[str] = (), how: str = "inner", width: float | None = None) -> DataFrame:
    """The nearest right row within ``radius`` (inclusive) of each left row, with ``d2``.

    ``key`` identifies left rows within ``on``; ``tie`` orders right rows at one distance.
    ``radius`` may be a left column, given a bin ``width``; it is 4 radii for a number.  ``how``: inner or left.
    """
    dx, dy = F.col(x[0]) - F.col(x[1]), F.col(y[0]) - F.col(y[1])
    d2 = dx * dx + dy * dy
    r = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    if isinstance(radius, str):
        # left rows look around; right rows stay in their cells
        pairs = range_join(right, left, [Axis(x[1], x[0], radius, width), Axis(y[1], y[0], radius, width)], d2 <= r * r, on)
    else:
        # left rows, mostly the many, are sent once; right rows look around in cells so wide that they touch few
        width = WIDE * radius if width is None else width
        pairs = range_join(left, right, [Axis(x[0], x[1], radius, width), Axis(y[0], y[1], radius, width)], d2 <= r * r, on)
    pairs = pairs.select(*(c for c in left.columns), *(c for c in right.columns if c not in on), d2.alias("d2")) if on else pairs.withColumn("d2", d2)
    best = Window.partitionBy(*on, key).orderBy("d2", *tie)
    found = pairs.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn")
    if how == "inner":
        return found
    return left.join(found.select(*on, key, *(c for c in right.columns if c not in on), "d2"), [*on, key], "left")


def mutual_best(pairs: DataFrame, left: Sequence[str], right: Sequence[str], distance: str = "d2", tie: Sequence[str] = ()) -> DataFrame:
    """Of nearest pairs, keep for each right row its closest left row (first by ``tie``)."""
    w = Window.partitionBy(*right).orderBy(distance, *tie, *left)
    return pairs.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

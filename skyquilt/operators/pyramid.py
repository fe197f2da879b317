"""Star pyramid: the brightest stars of every cell, level by level on finer grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.operators.grid import RingGrid
from skyquilt.session import cut

MAX_LEVELS = 60


@dataclass(frozen=True)
class PyramidOptions:
    stars_per_cell: int = 4
    max_cell_deg: float = 16.0
    min_cell_deg: float = 0.1
    #: a level filled to a smaller share is the last
    min_fill: float = 0.35


def brightness(mag: str = "mag") -> Column:
    """Sort key: magnitudes compare as floats, ties by id."""
    return (F.col(mag) + 100).cast("float")


def brightest(df: DataFrame, by: list[str], k: int, mag: str = "mag", id_: str = "id") -> DataFrame:
    """Rank rows of each group by brightness into ``rn``; ranks over ``k`` are pruned before the shuffle when filtered."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(brightness(mag), F.col(id_))))


def one_level(stars: DataFrame, grid: RingGrid, level: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Stars of a level, with ``level, cell, rn``, and the rest."""
    ranked = brightest(grid.with_cell(stars), ["cell"], k)
    return ranked.where(F.col("rn") <= k).withColumn("level", F.lit(level)), ranked.where(F.col("rn") > k).drop("cell", "rn")


def fixed_levels(stars: DataFrame, sizes_deg: list[float], k: int) -> DataFrame:
    """A pyramid of given cell sizes, without leftovers.  Ranks of a level are cut, so that no level replays those before."""
    out, rest = None, stars
    for level, size in enumerate(sizes_deg):
        ranked = cut(brightest(RingGrid(math.radians(size)).with_cell(rest), ["cell"], k))
        top, rest = ranked.where(F.col("rn") <= k).withColumn("level", F.lit(level)), ranked.where(F.col("rn") > k).drop("cell", "rn")
        out = top if out is None else out.unionByName(top)
    return out


def build_pyramid(stars: DataFrame, options: PyramidOptions = PyramidOptions()) -> tuple[DataFrame, list[RingGrid]]:
    """All stars with ``level, cell, rn`` and the grids of the levels.

    A level takes the ``stars_per_cell`` brightest of each cell of what is left;
    cells shrink by the square root of 2.  The last level is the one filled to
    under ``min_fill``, or of the smallest cells; what is left after it forms
    one more level on its grid.  Every level is cut, so that plans stay short.
    """
    size, rest, parts, grids = math.radians(options.max_cell_deg), cut(stars), [], []
    left = rest.count()
    while left and len(grids) < MAX_LEVELS:
        grid = RingGrid(size)
        top, below = one_level(rest, grid, len(grids), options.stars_per_cell)
        top, rest = cut(top), cut(below)
        grids.append(grid)
        parts.append(top)
        taken = top.count()
        left -= taken
        if taken < options.min_fill * options.stars_per_cell * grid.cells or math.degrees(size / math.sqrt(2)) < options.min_cell_deg:
            break
        size /= math.sqrt(2)
    if left:
        last = RingGrid(size)
        parts.append(brightest(last.with_cell(rest), ["cell"], 0).withColumn("level", F.lit(len(grids))))
        grids.append(last)
    out = parts[0] if parts else rest.withColumn("cell", F.lit(0)).withColumn("rn", F.lit(1)).withColumn("level", F.lit(0))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, grids


def cell_starts(stars: DataFrame) -> DataFrame:
    """``level, cell, n, first``: stars of each cell and the position of the first, in order of level and cell.

    The running total is taken over levels first and inside each level after, so
    that no task sees all cells.
    """
    counts = stars.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n"))
    levels = counts.groupBy("level").agg(F.sum("n").alias("__n"))
    before = levels.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("level", "__base")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("level").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__in", inside).join(F.broadcast(before), "level").select("level", "cell", "n", (F.col("__base") + F.col("__in")).alias("first"))


def positions(stars: DataFrame) -> DataFrame:
    """Add ``pos``: place in order of level, cell and brightness, from 0."""
    return stars.join(cell_starts(stars).select("level", "cell", "first"), ["level", "cell"]).withColumn("pos", F.col("first") + F.col("rn") - 1).drop("first")


def level_for(cumulative: list[int], area_sr: float, target: int) -> int:
    """First level at which an area holds ``target`` stars on average, or the last."""
    for level, n in enumerate(cumulative[:-1]):
        if n / (4 * math.pi) * area_sr >= target:
            return level
    return len(cumulative) - 1


def whole_levels(stars: DataFrame, count: int) -> DataFrame:
    """Stars of whole levels, brightest first, until ``count`` is reached (maybe more)."""
    sizes = stars.groupBy("level").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.withColumn("__before", before).where(F.col("__before") < count).select("level")
    return stars.join(F.broadcast(wanted), "level")


def brightness_rank(stars: DataFrame, mag: str = "mag", id_: str = "id", step: float = 0.01) -> DataFrame:
    """Add ``rank``, from 0, over all stars by brightness; stars without a magnitude come last.

    Stars are ranked inside steps of magnitude; the counts of steps, a few
    thousand rows, give the offsets, so no task sorts the whole catalog.
    """
    rows = stars.withColumn("__step", F.floor(brightness(mag) / step))
    counts = rows.groupBy("__step").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__step", F.coalesce(F.sum("__n").over(Window.orderBy(F.col("__step").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__step").orderBy(brightness(mag), id_)) - 1
    before = before.withColumnRenamed("__step", "__of")
    return rows.withColumn("__in", inside).join(before, F.col("__step").eqNullSafe(F.col("__of"))).withColumn("rank", F.col("__before") + F.col("__in")).drop("__step", "__of", "__in", "__before")

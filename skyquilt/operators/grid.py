"""Ring grid: sky cells of similar area, numbered from south to north and by right ascension."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions.sphere import HALF_PI, TWO_PI, angle_to_chord2, to_vector


@dataclass(frozen=True)
class RingGrid:
    """Rings of declination of about ``cell_size`` radians, cut into cells of about that width."""

    cell_size: float

    @cached_property
    def rings(self) -> int:
        return max(1, math.floor(math.pi / self.cell_size + 0.5))

    @property
    def height(self) -> float:
        return math.pi / self.rings

    @cached_property
    def counts(self) -> list[int]:
        mid = [-HALF_PI + (r + 0.5) * self.height for r in range(self.rings)]
        return [max(1, math.ceil(TWO_PI * math.cos(m) / self.height - 1e-9)) for m in mid]

    @cached_property
    def starts(self) -> list[int]:
        out = [0]
        for n in self.counts:
            out.append(out[-1] + n)
        return out

    @property
    def cells(self) -> int:
        return self.starts[-1]

    @property
    def max_cell_radius(self) -> float:
        """Bound of the distance of a cell's points from its centre."""
        return 0.8 * self.height

    def table(self, spark: SparkSession) -> DataFrame:
        """``ring, n, start``: pi / cell_size rows, so it may be broadcast at any size of data."""
        rows = [(r, n, s) for r, (n, s) in enumerate(zip(self.counts, self.starts))]
        return spark.createDataFrame(rows, "__ring int, __n int, __start int")

    def ring_of(self, dec: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.rings - 1), F.floor((dec + HALF_PI) / F.lit(self.height)))).cast("int")

    def with_cell(self, df: DataFrame, ra: str | Column = "ra", dec: str | Column = "dec", out: str = "cell") -> DataFrame:
        """Add the cell of a position."""
        ra, dec = (F.col(c) if isinstance(c, str) else c for c in (ra, dec))
        joined = df.withColumn("__ring", self.ring_of(dec)).join(F.broadcast(self.table(df.sparkSession)), "__ring")
        turn = ra / F.lit(TWO_PI) - F.floor(ra / F.lit(TWO_PI))
        column = F.least(F.col("__n") - 1, F.floor(turn * F.col("__n")).cast("int"))
        return joined.withColumn(out, F.col("__start") + column).drop("__ring", "__n", "__start")

    def centers(self, spark: SparkSession) -> DataFrame:
        """``cell, ra, dec`` of every cell."""
        rings = self.table(spark)
        cells = rings.select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__c"))
        return cells.select((F.col("__start") + F.col("__c")).alias("cell"), ((F.col("__c") + 0.5) * TWO_PI / F.col("__n")).alias("ra"), (F.lit(-HALF_PI) + (F.col("__ring") + 0.5) * F.lit(self.height)).alias("dec"))

    def cone_ranges(self, cones: DataFrame, ra: str = "ra", dec: str = "dec", radius: str = "radius") -> DataFrame:
        """Each cone with the cell ranges ``lo <= cell < hi`` that cover it; polar cones take whole rings."""
        ring0, ring1 = self.ring_of(F.col(dec) - F.col(radius)), self.ring_of(F.col(dec) + F.col(radius))
        s = F.sin(radius) / F.cos(dec)
        polar = (F.col(dec) + F.col(radius) >= HALF_PI) | (F.col(dec) - F.col(radius) <= -HALF_PI) | (s >= 1)
        half = F.when(polar, F.lit(math.pi)).otherwise(F.asin(F.least(s, F.lit(1.0))))
        rows = cones.withColumn("__half", half).withColumn("__ring", F.explode(F.sequence(ring0, ring1))).join(F.broadcast(self.table(cones.sparkSession)), "__ring")
        turn = F.col(ra) - F.floor(F.col(ra) / TWO_PI) * TWO_PI
        c0, c1 = (F.floor((turn + k * F.col("__half")) / TWO_PI * F.col("__n")) for k in (-1, 1))
        n, start = F.col("__n"), F.col("__start")
        m0, m1 = F.pmod(c0, n), F.pmod(c1, n)
        span = lambda lo, hi: F.struct((start + lo).cast("int").alias("lo"), (start + hi).cast("int").alias("hi"))
        ranges = F.when(c1 - c0 + 1 >= n, F.array(span(F.lit(0), n))).when(m0 <= m1, F.array(span(m0, m1 + 1))).otherwise(F.array(span(F.lit(0), m1 + 1), span(m0, n)))
        rows = rows.withColumn("__range", F.explode(ranges))
        return rows.withColumn("lo", F.col("__range.lo")).withColumn("hi", F.col("__range.hi")).drop("__half", "__ring", "__n", "__start", "__range")

    def cone_join(self, cones: DataFrame, stars: DataFrame, cell: str = "cell") -> DataFrame:
        """Stars inside each cone (``cone_ra, cone_dec, cone_radius``): cell ranges become an equi-join
        on cells, the exact test follows."""
        ranges = self.cone_ranges(cones, "cone_ra", "cone_dec", "cone_radius")
        cells = ranges.withColumn(cell, F.explode(F.sequence("lo", F.col("hi") - 1))).drop("lo", "hi").distinct()
        a, b = to_vector(F.col("cone_ra"), F.col("cone_dec")), to_vector(F.col("ra"), F.col("dec"))
        chord2 = sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))
        return cells.join(stars, cell).where(chord2 <= angle_to_chord2(F.least(F.col("cone_radius"), F.lit(math.pi))))

    def cone_filter(self, stars: DataFrame, ra: float, dec: float, radius: float, cell: str = "cell") -> DataFrame:
        """Stars inside one cone: ranges of ``cell`` that reach a Parquet scan, then the exact test."""
        spark = stars.sparkSession
        cone = spark.createDataFrame([(ra, dec, radius)], "ra double, dec double, radius double")
        near = F.lit(False)
        for r in self.cone_ranges(cone).select("lo", "hi").collect():  # two a ring at most
            near = near | ((F.col(cell) >= r.lo) & (F.col(cell) < r.hi))
        a, b = to_vector(F.lit(ra), F.lit(dec)), to_vector(F.col("ra"), F.col("dec"))
        chord2 = sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))
        return stars.where(near).where(chord2 <= 4 * math.sin(min(radius, math.pi) / 2) ** 2)

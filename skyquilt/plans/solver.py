"""Solving batches of images: attempts and stages, each a pass over all images not yet solved."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquilt.functions import wcs as wf
from skyquilt.functions.sphere import frac, moved
from skyquilt.operators import images, pyramid, quads, solve
from skyquilt.operators.grid import RingGrid
from skyquilt.operators.solve import SolverOptions
from skyquilt.plans import adapters as ad
from skyquilt.session import cut, table
from skyquilt.sinks.tables import read_index


@dataclass(frozen=True)
class Stage:
    """What a pass searches: which detections, how many, how exactly, as seen through which lens."""

    name: str
    keep: str = "all"
    stars: int = 32
    tolerance: float = 0.004
    focal: float | None = None


def attempts(hints: DataFrame) -> DataFrame:
    """Up to three attempts an image, as rows: near the hinted position at the hinted scale, anywhere
    at the hinted scale within 25 %, and anywhere at any scale."""
    none = F.lit(None).cast("double")
    row = lambda n, ra, dec, radius, low, high, stars: F.struct(F.lit(n).alias("attempt"), ra.alias("hint_ra"), dec.alias("hint_dec"), radius.alias("hint_radius"), low.alias("min_scale"), high.alias("max_scale"), F.lit(stars).alias("stars"))
    scale, ra, dec = F.col("hint_scale"), F.col("hint_ra"), F.col("hint_dec")
    low, high = F.coalesce(scale * 0.75, F.lit(0.0)), F.coalesce(scale * 1.25, F.lit(1e9))
    near = F.when(ra.isNotNull() & dec.isNotNull(), row(0, ra, dec, F.lit(10.0), low, high, 30))
    scaled = F.when(scale.isNotNull(), row(1, none, none, none, low, high, 32))
    full = row(2, none, none, none, F.lit(0.0), F.lit(1e9), 32)
    return hints.select("image_id", F.explode(F.filter(F.array(near, scaled, full), lambda a: a.isNotNull())).alias("a")).select("image_id", "a.*")


def stages(options: SolverOptions = SolverOptions(), wide_diagonal_px: float | None = None) -> list[Stage]:
    """Distinct stages in order: compact stars, all, concentrated, more stars, a loose tolerance, and
    the focal lengths of wide lenses."""
    few, most = options.stars, options.most_stars
    out = [Stage("compact", "compact", few), Stage("all", "all", few), Stage("concentrated", "concentrated", most), Stage("more", "compact", most), Stage("loose", "compact", max(20, most // 2), options.tolerance)]
    if wide_diagonal_px:
        out += [Stage(f"wide {f:.0f}", "compact", most, options.tolerance, f) for f in wf.wide_focals(wide_diagonal_px)]
    return list(dict.fromkeys(out))


class Solver:
    """An index and its options.  ``stars``: ``id, ra, dec, mag``; ``quads``: of :func:`quads.build`."""

    def __init__(self, stars: DataFrame, quads_: DataFrame, cell_deg: float = 4.0, options: SolverOptions = SolverOptions()):
        self.grid = RingGrid(math.radians(cell_deg))
        motion = [c for c in ("pm_ra", "pm_dec") if c in stars.columns]
        self.stars = self.grid.with_cell(stars.select("id", "ra", "dec", "mag", *motion))
        self.index = solve.located(quads_, stars.select("id", "ra", "dec"))
        self.options = options

    @classmethod
    def open(cls, spark: SparkSession, path: str, **kwargs) -> Solver:
        stars, _, q = read_index(spark, path)
        return cls(stars, q, **kwargs)

    def at_epoch(self, years: float) -> Solver:
        """The solver with its stars moved by their proper motions."""
        if "pm_ra" not in self.stars.columns:
            return self
        ra, dec = moved(F.col("ra"), F.col("dec"), F.col("pm_ra"), F.col("pm_dec"), years)
        out = object.__new__(Solver)
        out.__dict__.update(self.__dict__, stars=self.grid.with_cell(self.stars.drop("cell").withColumns({"ra": ra, "dec": dec})))
        return out

    def _kept(self, detections: DataFrame, keep: str) -> DataFrame:
        if keep == "all" or "fwhm" not in detections.columns:
            return detections
        chosen = images.compact(detections) if keep == "compact" else images.concentrated(detections)
        w = Window.partitionBy("image_id").orderBy("rank")
        return chosen.withColumn("rank", F.row_number().over(w) - 1)

    def solve(self, detections: DataFrame, sizes: DataFrame, hints: DataFrame | None = None, plan: list[Stage] | None = None) -> DataFrame:
        """One row for each solved image, with the stage that solved it.

        The driver loops over stages only; a stage works on all images that no
        stage before has solved, and ends the loop when none is left.
        """
        left, found = cut(detections), []
        plan = plan or stages(self.options)
        if "fwhm" not in detections.columns:  # nothing tells compact stars from others
            plan = list({(s.stars, s.tolerance, s.focal): replace(s, keep="all") for s in reversed(plan)}.values())[::-1]
        for stage in plan:
            options = replace(self.options, stars=stage.stars, tolerance=stage.tolerance)
            rows = self._kept(left, stage.keep)
            if stage.focal:
                x, y = wf.stereographic(F.col("x"), F.col("y"), (F.col("width") - 1) / 2, (F.col("height") - 1) / 2, F.lit(stage.focal))
                rows = rows.join(sizes, "image_id").withColumns({"x": x, "y": y}).drop("width", "height")
            got = solve.solve_pass(rows, sizes, self.stars, self.grid, self.index, options, stage.focal is None)
            if hints is not None:
                got = within(got, attempts(hints))
            got = cut(got.withColumn("stage", F.lit(stage.name)))
            found.append(got)
            left = cut(left.join(got.select("image_id"), "image_id", "left_anti"))
            if left.isEmpty():
                break
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out


def within(solutions: DataFrame, limits: DataFrame) -> DataFrame:
    """Solutions that some attempt of their image allows, with the first such ``attempt``."""
    v = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(F.radians("dec")) * F.sin(F.radians("hint_dec")) + F.cos(F.radians("dec")) * F.cos(F.radians("hint_dec")) * F.cos(F.radians(F.col("ra") - F.col("hint_ra"))))))
    near = F.col("hint_ra").isNull() | (F.degrees(v) <= F.col("hint_radius"))
    ok = solutions.select("image_id", "ra", "dec", "scale").join(limits, "image_id").where(near & (F.col("scale") >= F.col("min_scale")) & (F.col("scale") <= F.col("max_scale")))
    return solutions.join(ok.groupBy("image_id").agg(F.min("attempt").alias("attempt")), "image_id")


SIZES = [16.0, 16 / math.sqrt(2), 8.0]
SCALE = 100.0


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields with known world coordinates, one a nation; declinations from -66 degrees in steps of 5.5."""
    k, s, r = F.col("n_nationkey"), SCALE / 3600, F.radians(F.col("n_nationkey") * 29)
    w = wf.linear(F.lit(799.5), F.lit(599.5), k * 61.0 % 360, k * 5.5 - 66, (-s * F.cos(r), s * F.sin(r), s * F.sin(r), s * F.cos(r)))
    return table(spark, d, "nation").select(k.cast("long").alias("image_id"), w.alias("w"))


def star_lists(spark: SparkSession, d: str) -> DataFrame:
    """The 150 brightest stars of each field, at their pixels with a little deterministic noise."""
    grid = RingGrid(math.radians(8))
    cones = _fields(spark, d).withColumns({"cone_ra": F.radians("w.crval_ra"), "cone_dec": F.radians("w.crval_dec"), "cone_radius": F.lit(math.atan(math.radians(SCALE / 3600) * 1000) * 1.02)})
    rows = grid.cone_join(cones, grid.with_cell(ad.stars(spark, d))).withColumn("p", wf.sky_to_pixel(F.col("w"), F.degrees("ra"), F.degrees("dec")))
    rows = rows.where("p.x between 0 and 1599 and p.y between 0 and 1199")
    w = Window.partitionBy("image_id").orderBy("mag", "id")
    noise = lambda c: 0.4 * (frac(F.col("id") * c) - 0.5)
    rows = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 150")
    return rows.select("image_id", (F.col("rn") - 1).alias("rank"), (F.col("p.x") + noise(ad.PHI)).alias("x"), (F.col("p.y") + noise(ad.RHO)).alias("y"))


def solve_star_lists(spark: SparkSession, d: str) -> DataFrame:
    """Solve star lists of known fields; the distance from the truth is part of the result."""
    levels = cut(pyramid.fixed_levels(ad.stars(spark, d), SIZES, 6))
    built = cut(quads.build(levels, [RingGrid(math.radians(z)) for z in SIZES], quads.QuadOptions(quads_per_cell=12, low=0.3, high=1.0)))
    det = cut(star_lists(spark, d))
    sizes = det.select("image_id").distinct().select("image_id", F.lit(1600).alias("width"), F.lit(1200).alias("height"))
    got = Solver(levels, built, 8.0).solve(det, sizes)
    truth = _fields(spark, d).select("image_id", F.col("w").alias("t"))
    both = got.join(truth, "image_id").withColumn("p", wf.sky_to_pixel(F.col("t"), F.col("ra"), F.col("dec")))
    off = F.sqrt((F.col("p.x") - 799.5) * (F.col("p.x") - 799.5) + (F.col("p.y") - 599.5) * (F.col("p.y") - 599.5))
    return both.select("image_id", "stage", F.round("scale", 2).alias("scale"), F.round("rotation", 2).alias("rotation"), "flipped", (F.col("pairs") >= 8).alias("matched"), (off < 1).alias("centred"))


def plan_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of images of which some hints are known."""
    k = F.col("c_custkey")
    hints = table(spark, d, "customer").select(k.alias("image_id"), F.when(k % 2 == 0, (k % 360).cast("double")).alias("hint_ra"), F.when(k % 2 == 0, (k % 90).cast("double")).alias("hint_dec"), F.when(k % 3 == 0, (k % 50) / 4.0 + 1).alias("hint_scale"))
    return attempts(hints).select("image_id", "attempt", "min_scale", "max_scale", "stars")


QUERIES = {"solve_star_lists": solve_star_lists, "plan_attempts": plan_attempts}
ORACLES = {
    "plan_attempts": "WITH h AS (SELECT c_custkey AS image_id, c_custkey % 2 = 0 AS near, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 / 4.0::double + 1 END AS s FROM customer) SELECT image_id, 0 AS attempt, coalesce(s * 0.75::double, 0) AS min_scale, coalesce(s * 1.25::double, 1e9) AS max_scale, 30 AS stars FROM h WHERE near UNION ALL SELECT image_id, 1, s * 0.75::double, s * 1.25::double, 32 FROM h WHERE s IS NOT NULL UNION ALL SELECT image_id, 2, 0, 1e9, 32 FROM h",
}

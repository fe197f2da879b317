"""Queries over the catalog: grid, pyramid, cones, projections, pairs and quads."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions import sphere
from skyquilt.functions.quadcode import wide_bins_for
from skyquilt.functions.sphere import ARCSEC, HALF_PI, MAS, TWO_PI, TangentPlane, ra_of, dec_of, separation, to_vector
from skyquilt.operators import pyramid, quads
from skyquilt.operators.grid import RingGrid
from skyquilt.operators.rangejoin import Axis, range_join
from skyquilt.plans import adapters as ad
from skyquilt.session import cut, table

COARSE = math.radians(8)
CONE = (1.2, 0.4, math.radians(15))


def rings_sql(name: str, size: float) -> str:
    g = RingGrid(size)
    rows = ", ".join(f"({r}, {n}, {s})" for r, (n, s) in enumerate(zip(g.counts, g.starts)))
    return f"{name}(ring, n, start) AS (VALUES {rows})"


def cell_sql(source: str, rings: str, size: float, keep: str = "s.*", ra: str = "ra", dec: str = "dec") -> str:
    g = RingGrid(size)
    return f"""SELECT {keep}, (start + least(n - 1, floor(({ra} / {TWO_PI} - floor({ra} / {TWO_PI})) * n)))::int AS cell
  FROM {source} s JOIN {rings} ON ring = greatest(0, least({g.rings - 1}, floor(({dec} + {HALF_PI}) / {g.height})))::int"""


def pyramid_level0(spark: SparkSession, d: str) -> DataFrame:
    top, _ = pyramid.one_level(ad.stars(spark, d), RingGrid(COARSE), 0, 4)
    return top.select("cell", "id", F.round("mag", 6).alias("mag"), "rn")


def top_sql(source: str, rings: str, size: float, k: int, level: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY cell ORDER BY (mag + 100)::float, id) AS rn, {level} AS level FROM ({cell_sql(source, rings, size)})"


LEVELS = [16.0, 16 / math.sqrt(2), 8.0]


def _levels_sql() -> str:
    parts, source = [f"s AS ({ad.STARS})", *(rings_sql(f"r{k}", math.radians(z)) for k, z in enumerate(LEVELS))], "s"
    for k, z in enumerate(LEVELS):
        parts.append(f"t{k} AS ({top_sql(source, f'r{k}', math.radians(z), 4, k)})")
        parts.append(f"x{k} AS (SELECT id, ra, dec, mag, pm_ra, pm_dec FROM t{k} WHERE rn > 4)")
        source = f"x{k}"
    union = " UNION ALL ".join(f"SELECT level, cell, id, rn FROM t{k} WHERE rn <= 4" for k in range(len(LEVELS)))
    return "WITH " + ", ".join(parts) + f", u AS ({union})"


def pyramid_levels_3(spark: SparkSession, d: str) -> DataFrame:
    stars = pyramid.fixed_levels(ad.stars(spark, d), LEVELS, 4)
    return pyramid.positions(stars).select("level", "cell", "id", "rn", "pos")


def pyramid_adaptive(spark: SparkSession, d: str) -> DataFrame:
    stars, _ = pyramid.build_pyramid(ad.stars(spark, d), pyramid.PyramidOptions(min_cell_deg=2))
    return stars.groupBy("level").agg(F.count(F.lit(1)).alias("n_stars"), F.countDistinct("cell").alias("n_cells"), F.max("rn").alias("most"), F.round(F.max("mag"), 6).alias("faintest"))


def cell_counts_prefix(spark: SparkSession, d: str) -> DataFrame:
    stars = RingGrid(COARSE).with_cell(ad.stars(spark, d)).withColumn("level", F.lit(0))
    return pyramid.cell_starts(stars).select("cell", "n", "first")


def cone_search(spark: SparkSession, d: str) -> DataFrame:
    grid = RingGrid(COARSE)
    found = grid.cone_filter(grid.with_cell(ad.stars(spark, d)), *CONE)
    return found.select("id", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"), F.round("mag", 6).alias("mag"))


_CONE_SQL = f"{{0}} WHERE (cos(dec) * cos(ra) - {math.cos(CONE[1]) * math.cos(CONE[0])!r}) ** 2 + (cos(dec) * sin(ra) - {math.cos(CONE[1]) * math.sin(CONE[0])!r}) ** 2 + (sin(dec) - {math.sin(CONE[1])!r}) ** 2 <= {4 * math.sin(CONE[2] / 2) ** 2!r}"


def cone_search_limit_levels(spark: SparkSession, d: str) -> DataFrame:
    stars = pyramid.fixed_levels(ad.stars(spark, d), LEVELS, 4)
    near = [RingGrid(math.radians(z)).cone_filter(stars.where(F.col("level") == k), *CONE) for k, z in enumerate(LEVELS)]
    found = near[0].unionByName(near[1]).unionByName(near[2])
    return pyramid.whole_levels(found, 20).select("level", "id", F.round("mag", 6).alias("mag"))


def cones_of_nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    cones = n.select(F.col("n_nationkey").alias("cone"), (F.col("n_nationkey") * 0.25).alias("cone_ra"), (F.col("n_nationkey") * 0.125 - 1.5).alias("cone_dec"), F.lit(0.12).alias("cone_radius"))
    grid = RingGrid(COARSE)
    return grid.cone_join(cones, grid.with_cell(ad.stars(spark, d))).select("cone", "id")


def cell_centers(spark: SparkSession, d: str) -> DataFrame:
    grid = RingGrid(math.radians(5))
    return grid.with_cell(grid.centers(spark).withColumnRenamed("cell", "own")).select("own", "cell", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


def proper_motion_positions(spark: SparkSession, d: str) -> DataFrame:
    s = ad.stars(spark, d)
    ra, dec = sphere.moved(F.col("ra"), F.col("dec"), F.col("pm_ra"), F.col("pm_dec"), 24.5)
    x, y, z = to_vector(ra, dec)
    return s.select("id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"), F.round(separation(F.col("ra"), F.col("dec"), ra, dec) / ARCSEC, 6).alias("moved_arcsec"))


def tangent_projection(spark: SparkSession, d: str) -> DataFrame:
    """Every star in front of the plane, projected and back."""
    s = ad.stars(spark, d)
    plane = TangentPlane.at(F.lit(0.7), F.lit(0.3))
    v = to_vector(F.col("ra"), F.col("dec"))
    s = s.where(plane.dot(v) > 0.2)
    back = plane.unproject(plane.xi(v), plane.eta(v))
    return s.select("id", F.round(plane.xi(v), 6).alias("xi"), F.round(plane.eta(v), 6).alias("eta"), F.round(ra_of(back[0], back[1]), 6).alias("ra"), F.round(dec_of(back[2]), 6).alias("dec"))


def _tangent_sql() -> str:
    c0, c1, c2 = math.cos(0.3) * math.cos(0.7), math.cos(0.3) * math.sin(0.7), math.sin(0.3)
    h = math.hypot(c0, c1)
    e0, e1 = -c1 / h, c0 / h
    n0, n1, n2 = -c2 * e1, c2 * e0, c0 * e1 - c1 * e0
    return f"""WITH s AS ({ad.STARS}), v AS (SELECT id, ra, dec, cos(dec) * cos(ra) AS x, cos(dec) * sin(ra) AS y, sin(dec) AS z FROM s),
t AS (SELECT *, {c0!r} * x + {c1!r} * y + {c2!r} * z AS w FROM v)
SELECT id, round(({e0!r} * x + {e1!r} * y) / w, 6) AS xi, round(({n0!r} * x + {n1!r} * y + {n2!r} * z) / w, 6) AS eta, round(ra, 6) AS ra, round(dec, 6) AS dec FROM t WHERE w > 0.2"""


LOW, HIGH = math.radians(1.0), math.radians(3.0)


def separation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stars of level 0 with ``LOW`` <= distance < ``HIGH``, each in the cell of its midpoint."""
    grid = RingGrid(COARSE)
    top, _ = pyramid.one_level(ad.stars(spark, d), grid, 0, 4)
    pairs = quads.pairs(top.select("id", "ra", "dec"), grid, LOW, HIGH)
    return pairs.select("cell", "a", "b", F.round(F.col("distance"), 6).alias("distance"))


_PAIRS = f"""p AS (SELECT a.id AS a, b.id AS b, 2 * asin(least(1, sqrt((cos(a.dec) * cos(a.ra) - cos(b.dec) * cos(b.ra)) ** 2 + (cos(a.dec) * sin(a.ra) - cos(b.dec) * sin(b.ra)) ** 2 + (sin(a.dec) - sin(b.dec)) ** 2) / 2)) AS distance,
  cos(a.dec) * cos(a.ra) + cos(b.dec) * cos(b.ra) AS x, cos(a.dec) * sin(a.ra) + cos(b.dec) * sin(b.ra) AS y, sin(a.dec) + sin(b.dec) AS z
  FROM t a JOIN t b ON a.id < b.id),
m AS (SELECT a, b, distance, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + {TWO_PI} ELSE atan2(y, x) END AS ra, asin(z / sqrt(x * x + y * y + z * z)) AS dec FROM p WHERE distance >= {LOW!r} AND distance < {HIGH!r})"""
_TOP = f"s AS ({ad.STARS}), {rings_sql('r', COARSE)}, t AS (SELECT * FROM ({top_sql('s', 'r', COARSE, 4, 0)}) WHERE rn <= 4)"

QUAD_LOW, QUAD_HIGH = math.radians(6.0), math.radians(12.0)


def quads_uncapped(spark: SparkSession, d: str) -> DataFrame:
    """Every quad of the stars of level 0: C and D inside the circle on AB, in canonical order, with its code."""
    grid = RingGrid(COARSE)
    top, _ = pyramid.one_level(ad.stars(spark, d), grid, 0, 4)
    q = quads.uncapped(cut(top.select("id", "ra", "dec")), grid, QUAD_LOW, QUAD_HIGH)
    return q.select("a", "b", "c", "d", "cx", "cy", "dx", "dy")


def _quads_sql() -> str:
    """Pairs by cubes of the largest chord, members by cubes of the circle's reach."""
    far, reach = 2 * math.sin(QUAD_HIGH / 2), 2 * math.sin(QUAD_HIGH / 4) + 1e-3
    cube = lambda v, w: ", ".join(f"floor({x} / {w!r})::int AS {n}" for n, x in zip(("i", "j", "k"), v))
    around = "SELECT unnest([-1, 0, 1]) AS u"
    return f"""WITH {_TOP}, u AS (SELECT id, cos(dec) * cos(ra) AS x, cos(dec) * sin(ra) AS y, sin(dec) AS z FROM t), nine AS ({around}),
s1 AS (SELECT *, {cube("xyz", far)} FROM u), s2 AS (SELECT s1.* REPLACE (i + a.u AS i, j + b.u AS j, k + c.u AS k) FROM s1, nine a, nine b, nine c),
p AS (SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, a.x + b.x AS mx, a.y + b.y AS my, a.z + b.z AS mz
  FROM s2 a JOIN s1 b USING (i, j, k) WHERE a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 >= {4 * math.sin(QUAD_LOW / 2) ** 2!r} AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < {4 * math.sin(QUAD_HIGH / 2) ** 2!r}),
q AS (SELECT *, mx / sqrt(mx * mx + my * my + mz * mz) AS c0, my / sqrt(mx * mx + my * my + mz * mz) AS c1, mz / sqrt(mx * mx + my * my + mz * mz) AS c2 FROM p),
e AS (SELECT *, -c1 / sqrt(c0 * c0 + c1 * c1) AS e0, c0 / sqrt(c0 * c0 + c1 * c1) AS e1 FROM q),
n AS (SELECT *, -c2 * e1 AS n0, c2 * e0 AS n1, c0 * e1 - c1 * e0 AS n2 FROM e),
f AS (SELECT *, (e0 * ax + e1 * ay) / (c0 * ax + c1 * ay + c2 * az) AS px, (n0 * ax + n1 * ay + n2 * az) / (c0 * ax + c1 * ay + c2 * az) AS py,
  (e0 * bx + e1 * by_) / (c0 * bx + c1 * by_ + c2 * bz) AS qx, (n0 * bx + n1 * by_ + n2 * bz) / (c0 * bx + c1 * by_ + c2 * bz) AS qy, {cube(("mx / 2", "my / 2", "mz / 2"), reach)} FROM n),
o1 AS (SELECT *, {cube("xyz", reach)} FROM u), o2 AS (SELECT o1.* REPLACE (i + a.u AS i, j + b.u AS j, k + c.u AS k) FROM o1, nine a, nine b, nine c),
g AS (SELECT f.*, o2.id AS o, (e0 * o2.x + e1 * o2.y) / (c0 * o2.x + c1 * o2.y + c2 * o2.z) AS ox, (n0 * o2.x + n1 * o2.y + n2 * o2.z) / (c0 * o2.x + c1 * o2.y + c2 * o2.z) AS oy
  FROM f JOIN o2 USING (i, j, k) WHERE o2.id <> a AND o2.id <> b AND c0 * o2.x + c1 * o2.y + c2 * o2.z > 0),
h AS (SELECT a, b, o, ((ox - px) * (qx - px) + (oy - py) * (qy - py)) / ((qx - px) ** 2 + (qy - py) ** 2) AS zr, ((oy - py) * (qx - px) - (ox - px) * (qy - py)) / ((qx - px) ** 2 + (qy - py) ** 2) AS zi FROM g),
i AS (SELECT * FROM h WHERE zr * zr + zi * zi - zr <= 0),
j AS (SELECT k.a, k.b, k.o AS c, l.o AS d, k.zr AS cr, k.zi AS ci, l.zr AS dr, l.zi AS di, k.zr + l.zr > 1 AS flip FROM i k JOIN i l ON k.a = l.a AND k.b = l.b AND k.o < l.o),
w AS (SELECT CASE WHEN flip THEN b ELSE a END AS a, CASE WHEN flip THEN a ELSE b END AS b, c, d, CASE WHEN flip THEN 1 - cr ELSE cr END AS cr, CASE WHEN flip THEN -ci ELSE ci END AS ci, CASE WHEN flip THEN 1 - dr ELSE dr END AS dr, CASE WHEN flip THEN -di ELSE di END AS di FROM j),
v AS (SELECT a, b, CASE WHEN cr > dr THEN d ELSE c END AS c, CASE WHEN cr > dr THEN c ELSE d END AS d, least(cr, dr) AS cx, CASE WHEN cr > dr THEN di ELSE ci END AS cy, greatest(cr, dr) AS dx, CASE WHEN cr > dr THEN ci ELSE di END AS dy FROM w)
SELECT a, b, c, d, greatest(0, least(65535, floor(cx * 65535 + 0.5)))::int AS cx, greatest(0, least(65535, floor((cy + 0.5) * 65535 + 0.5)))::int AS cy,
  greatest(0, least(65535, floor(dx * 65535 + 0.5)))::int AS dx, greatest(0, least(65535, floor((dy + 0.5) * 65535 + 0.5)))::int AS dy FROM v"""


def quads_capped(spark: SparkSession, d: str) -> DataFrame:
    """Quads of the two upper levels under the caps of pairs, stars and cells, with their check stars."""
    stars = pyramid.fixed_levels(ad.stars(spark, d), LEVELS[:2], 4)
    return quads.build(stars, [RingGrid(math.radians(z)) for z in LEVELS[:2]], quads.QuadOptions(quads_per_cell=4))


TOL = 5000


def code_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of codes within ``TOL`` quantized units in four dimensions."""
    c = ad.codes(spark, d)
    probes = c.select(F.col("id").alias("probe"), *(F.col(f"c{k}").alias(f"q{k}") for k in range(4)))
    d2 = sum(((F.col(f"c{k}") - F.col(f"q{k}")).cast("long") * (F.col(f"c{k}") - F.col(f"q{k}")) for k in range(1, 4)), (F.col("c0") - F.col("q0")).cast("long") * (F.col("c0") - F.col("q0")))
    found = range_join(c.drop("diam"), probes, [Axis(f"c{k}", f"q{k}", TOL, 2 * TOL) for k in range(4)], (d2 <= TOL * TOL) & (F.col("id") != F.col("probe")))
    return found.select("id", "probe", d2.alias("d2"))


def wide_quads(spark: SparkSession, d: str) -> DataFrame:
    """Quads of a degree and more on the coarser grid of their own number: rows of each code cell."""
    wide = ad.codes(spark, d).where("diam >= 1")
    return quads.rebinned(wide, wide_bins_for(wide.count())).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


_WIDE = "w AS (SELECT * FROM (" + ad.CODES + ") WHERE diam >= 1), k AS (SELECT greatest(2, least(64, floor((count(*) / 4) ** 0.25)))::int AS b FROM w)"
_BIN = "least(b - 1, floor({0} * b / 65536.0::double))::int"


def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    """Two catalogs of one epoch, one of them moved to it first."""
    s = ad.stars(spark, d)
    old = s.where("id % 4 = 1").withColumn("epoch", F.lit(1991.25))
    ra, dec = sphere.moved(F.col("ra"), F.col("dec"), F.col("pm_ra"), F.col("pm_dec"), 8.75)
    old = old.select("id", ra.alias("ra"), dec.alias("dec"), "mag", F.lit(2000.0).alias("epoch"))
    new = s.where("id % 4 <> 1").select("id", "ra", "dec", "mag", F.lit(2000.0).alias("epoch"))
    both = union_catalogs(new, old)
    return both.select("id", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"), F.round("mag", 6).alias("mag"), "epoch")


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    """All rows of catalogs; an error if their epochs differ."""
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c)
    epochs = [c.agg(F.min("epoch"), F.max("epoch")).first() for c in catalogs]
    known = {e for row in epochs for e in row if e is not None}
    if len(known) > 1:
        raise ValueError(f"catalogs of different epochs: {sorted(known)}")
    return out


def chunk_top(spark: SparkSession, d: str) -> DataFrame:
    """The brightest 5 of every id chunk, as a bounded remote query would return them."""
    s = ad.stars(spark, d).withColumn("chunk", F.floor(F.col("id") / 1000))
    return pyramid.brightest(s, ["chunk"], 5).where("rn <= 5").select("chunk", "id", "rn")


def brightness_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank of every star by brightness, without a global sort."""
    return pyramid.brightness_rank(ad.stars(spark, d)).select("id", "rank")


QUERIES = {f.__name__: f for f in (pyramid_level0, pyramid_levels_3, pyramid_adaptive, cell_counts_prefix, cone_search, cone_search_limit_levels, cones_of_nations, cell_centers, proper_motion_positions, tangent_projection, separation_pairs, quads_uncapped, quads_capped, code_range_join, wide_quads, catalog_union, chunk_top, brightness_rank)}

_SEP = "2 * asin(least(1, sqrt(sin((d2 - dec) / 2) ** 2 + cos(dec) * cos(d2) * sin((r2 - ra) / 2) ** 2)))"
_MOVED = "SELECT *, CASE WHEN pm_ra = 0 AND pm_dec = 0 THEN ra ELSE r - {0} * floor(r / {0}) END AS r2, CASE WHEN pm_ra = 0 AND pm_dec = 0 THEN dec ELSE dec + pm_dec * {1!r} * {2} END AS d2 FROM (SELECT *, ra + pm_ra * {1!r} * {2} / greatest(cos(dec), 1e-6) AS r FROM ({3}))"
ORACLES = {
    "pyramid_level0": f"WITH s AS ({ad.STARS}), {rings_sql('r', COARSE)} SELECT cell, id, round(mag, 6) AS mag, rn FROM ({top_sql('s', 'r', COARSE, 4, 0)}) WHERE rn <= 4",
    "pyramid_levels_3": _levels_sql() + " SELECT level, cell, id, rn, row_number() OVER (ORDER BY level, cell, rn) - 1 AS pos FROM u",
    "cell_counts_prefix": f"WITH s AS ({ad.STARS}), {rings_sql('r', COARSE)}, c AS (SELECT cell, count(*) AS n FROM ({cell_sql('s', 'r', COARSE)}) GROUP BY cell) SELECT cell, n, (sum(n) OVER (ORDER BY cell) - n)::bigint AS first FROM c",
    "cone_search": "SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(mag, 6) AS mag FROM (" + _CONE_SQL.format(f"SELECT * FROM ({ad.STARS})") + ")",
    "cone_search_limit_levels": _levels_sql() + f", f AS ({_CONE_SQL.format('SELECT u.level, s.* FROM u JOIN s USING (id)')}), c AS (SELECT level, sum(count(*)) OVER (ORDER BY level) - count(*) AS b FROM f GROUP BY level) SELECT level, id, round(mag, 6) AS mag FROM f JOIN c USING (level) WHERE b < 20",
    "cones_of_nations": f"WITH s AS ({ad.STARS}) SELECT n_nationkey AS cone, id FROM nation, s WHERE (cos(dec) * cos(ra) - cos(n_nationkey * 0.125::double - 1.5) * cos(n_nationkey * 0.25::double)) ** 2 + (cos(dec) * sin(ra) - cos(n_nationkey * 0.125::double - 1.5) * sin(n_nationkey * 0.25::double)) ** 2 + (sin(dec) - sin(n_nationkey * 0.125::double - 1.5)) ** 2 <= {4 * math.sin(0.06) ** 2!r}",
    "cell_centers": f"WITH {rings_sql('r', math.radians(5))} SELECT start + c AS own, start + c AS cell, round((c + 0.5) * {TWO_PI} / n, 6) AS ra, round(-{HALF_PI} + (ring + 0.5) * {RingGrid(math.radians(5)).height!r}, 6) AS dec FROM (SELECT *, unnest(range(0, n)) AS c FROM r)",
    "proper_motion_positions": f"SELECT id, round(r2, 6) AS ra, round(d2, 6) AS dec, round(cos(d2) * cos(r2), 6) AS x, round(cos(d2) * sin(r2), 6) AS y, round(sin(d2), 6) AS z, round({_SEP} / {ARCSEC!r}, 6) AS moved_arcsec FROM ({_MOVED.format(TWO_PI, MAS, 24.5, ad.STARS)})",
    "tangent_projection": _tangent_sql(),
    "separation_pairs": f"WITH {_TOP}, {_PAIRS} SELECT cell, a, b, round(distance, 6) AS distance FROM ({cell_sql('m', 'r', COARSE)})",
    "quads_uncapped": _quads_sql(),
    "code_range_join": f"WITH c AS ({ad.CODES}), p AS (SELECT a.id, b.id AS probe, (a.c0 - b.c0)::bigint ** 2 + (a.c1 - b.c1)::bigint ** 2 + (a.c2 - b.c2)::bigint ** 2 + (a.c3 - b.c3)::bigint ** 2 AS d2 FROM c a JOIN c b ON a.id <> b.id AND abs(a.c0 - b.c0) <= {TOL}) SELECT id, probe, d2::bigint AS d2 FROM p WHERE d2 <= {TOL * TOL}",
    "wide_quads": f"WITH {_WIDE} SELECT ((({_BIN.format('c0')} * b + {_BIN.format('c1')}) * b + {_BIN.format('c2')}) * b + {_BIN.format('c3')}) AS cell, count(*) AS n, min(id) AS first FROM w, k GROUP BY cell",
    "catalog_union": f"SELECT id, round(CASE WHEN id % 4 = 1 THEN r2 ELSE ra END, 6) AS ra, round(CASE WHEN id % 4 = 1 THEN d2 ELSE dec END, 6) AS dec, round(mag, 6) AS mag, 2000.0::double AS epoch FROM ({_MOVED.format(TWO_PI, MAS, 8.75, ad.STARS)})",
    "brightness_rank": f"SELECT id, row_number() OVER (ORDER BY (mag + 100)::float, id) - 1 AS rank FROM ({ad.STARS})",
    "chunk_top": f"SELECT * FROM (SELECT floor(id / 1000)::bigint AS chunk, id, row_number() OVER (PARTITION BY floor(id / 1000) ORDER BY (mag + 100)::float, id) AS rn FROM ({ad.STARS})) WHERE rn <= 5",
}

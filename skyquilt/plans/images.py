"""Queries over pixels, star lists and their matches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.operators import images as im
from skyquilt.operators.rangejoin import mutual_best, nearest
from skyquilt.plans import adapters as ad
from skyquilt.session import table

TILE = 8
MED = "list_sort(list({0}))[count(*) // 2 + 1]"


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def tile_background(spark: SparkSession, d: str) -> DataFrame:
    t = im.sigma_floor(im.tile_background(ad.pixels(spark, d), TILE))
    return t.select("image_id", "tile_x", "tile_y", *r6("median", "sigma"))


_TILES = f"""p AS ({ad.PIXELS}), t AS (SELECT *, x // {TILE} AS tile_x, y // {TILE} AS tile_y FROM p),
m1 AS (SELECT image_id, tile_x, tile_y, {MED.format('v')} AS m FROM t GROUP BY ALL),
s1 AS (SELECT image_id, tile_x, tile_y, any_value(m) AS m, 1.4826 * {MED.format('abs(v - m)')} AS s FROM t JOIN m1 USING (image_id, tile_x, tile_y) GROUP BY ALL),
c AS (SELECT t.* FROM t JOIN s1 USING (image_id, tile_x, tile_y) WHERE abs(v - m) <= 3 * s),
m2 AS (SELECT image_id, tile_x, tile_y, {MED.format('v')} AS m FROM c GROUP BY ALL HAVING count(*) > 8),
s2 AS (SELECT image_id, tile_x, tile_y, any_value(m) AS m2, 1.4826 * {MED.format('abs(v - m)')} AS s2 FROM c JOIN m2 USING (image_id, tile_x, tile_y) GROUP BY ALL),
b AS (SELECT image_id, tile_x, tile_y, coalesce(m2, m) AS median, coalesce(s2, s) AS sigma FROM s1 LEFT JOIN s2 USING (image_id, tile_x, tile_y))"""


def tile_median_filter(spark: SparkSession, d: str) -> DataFrame:
    t = im.median_filter(im.tile_background(ad.pixels(spark, d), TILE))
    return t.select("image_id", "tile_x", "tile_y", *r6("median", "sigma"))


def smoothed_peaks(spark: SparkSession, d: str) -> DataFrame:
    s = im.smooth5(ad.pixels(spark, d)).withColumn("smooth", F.round(F.col("smooth") + 1e-7, 4))
    return im.local_maxima(s, "smooth", F.lit(30000.0)).select("image_id", "x", "y", "smooth")


_KERNEL = "(VALUES (-2, 1.0), (-1, 4.0), (0, 6.0), (1, 4.0), (2, 1.0))"
_PEAKS = f"""WITH p AS ({ad.PIXELS}), k(i, w) AS {_KERNEL},
h AS (SELECT image_id, x + i AS x, y, sum(v * w / 16) AS v FROM p, k GROUP BY ALL),
g AS (SELECT image_id, x, y + i AS y, sum(v * w / 16) AS v FROM h, k GROUP BY ALL),
s AS (SELECT image_id, x, y, round(g.v + 1e-7, 4) AS smooth FROM p JOIN g USING (image_id, x, y))
SELECT * FROM s WHERE smooth >= 30000 AND NOT EXISTS (SELECT 1 FROM s n WHERE n.image_id = s.image_id AND abs(n.x - s.x) <= 1 AND abs(n.y - s.y) <= 1 AND (n.x <> s.x OR n.y <> s.y)
  AND CASE WHEN n.y < s.y OR (n.y = s.y AND n.x < s.x) THEN n.smooth >= s.smooth ELSE n.smooth > s.smooth END)"""


def pixel_binning(spark: SparkSession, d: str) -> DataFrame:
    return im.binned(ad.pixels(spark, d), 5, 64, 48).select("image_id", "x", "y", F.round("v", 4).alias("v"))


def thumbnail_reduce(spark: SparkSession, d: str) -> DataFrame:
    return im.reduced(ad.pixels(spark, d), 64, 48, 10, 7).select("image_id", "x", "y", F.round(F.col("v") + 1e-7, 4).alias("v"))


def stretch_stats(spark: SparkSession, d: str) -> DataFrame:
    s = im.stretch(ad.pixels(spark, d), 3)
    black = F.greatest(F.lit(0.0), F.col("median") - 2.8 * F.col("mad"))
    shown = (F.col("median") - black) / (F.col("white") - black)
    return s.select("image_id", *r6("median", "mad", "white"), F.round(im.midtones_for(shown, 0.2), 6).alias("balance"), F.round(im.midtones(shown, im.midtones_for(shown, 0.2)), 6).alias("shown"))


_STRETCH = f"""WITH p AS ({ad.PIXELS}), s AS (SELECT image_id, v FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS n FROM p) WHERE n % 3 = 0),
m AS (SELECT image_id, {MED.format('v')} AS median, list_sort(list(v))[least(count(*) - 1, floor(count(*) * 0.9995::double)::int) + 1] AS white FROM s GROUP BY image_id),
q AS (SELECT image_id, any_value(median) AS median, any_value(white) AS white, {MED.format('abs(v - median)')} AS mad FROM s JOIN m USING (image_id) GROUP BY image_id),
r AS (SELECT *, (median - greatest(0, median - 2.8 * mad)) / (white - greatest(0, median - 2.8 * mad)) AS u FROM q), t AS (SELECT *, u * 0.8 / (u - 0.4 * u + 0.2) AS b FROM r)
SELECT image_id, round(median, 6) AS median, round(mad, 6) AS mad, round(white, 6) AS white, round(b, 6) AS balance, round((b - 1) * u / ((2 * b - 1) * u - b), 6) AS shown FROM t"""


def max_pixel(spark: SparkSession, d: str) -> DataFrame:
    return ad.pixels(spark, d).groupBy("image_id").agg(F.max("v").alias("brightest"), F.round(0.95 * F.max("v"), 6).alias("saturation"), F.count(F.lit(1)).alias("n"))


def median_fwhm(spark: SparkSession, d: str) -> DataFrame:
    return im.with_median_fwhm(ad.detections(spark, d)).groupBy("image_id").agg(F.round(F.first("median_fwhm"), 6).alias("median_fwhm"))


def compact_stars(spark: SparkSession, d: str) -> DataFrame:
    narrow = ad.detections(spark, d).withColumn("fwhm", F.when(F.col("star") % 3 == 0, F.col("fwhm") * 5).otherwise(F.col("fwhm")))
    return im.compact(narrow).select("image_id", "star")


def concentrated_stars(spark: SparkSession, d: str) -> DataFrame:
    return im.concentrated(ad.detections(spark, d)).select("image_id", "star")


def point_sources(spark: SparkSession, d: str) -> DataFrame:
    found = im.ranked(im.point_sources(ad.detections(spark, d)), "peak", 50)
    return found.select("image_id", "star", "rank", F.round("peak", 6).alias("peak"))


def top_stars(spark: SparkSession, d: str) -> DataFrame:
    return im.ranked(ad.detections(spark, d).where("not saturated"), "flux", 100).select("image_id", "star", "rank", "flux")


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    s = im.ranked(ad.detections(spark, d).where("snr >= 20 and not saturated"), "flux", 1000)
    return im.even_sample(s, 50).select("image_id", "star", "rank")


RADIUS = 6.0


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    stars = ad.detections(spark, d).select("image_id", "star", "x", "y")
    return nearest(stars, ad.references(spark, d), ("x", "rx"), ("y", "ry"), RADIUS, "star", ["ref"], ["image_id"])


def nearest_within_radius(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("image_id", "star", "ref", F.round("d2", 6).alias("d2"))


def mutual_match(spark: SparkSession, d: str) -> DataFrame:
    return mutual_best(_nearest(spark, d), ["star"], ["image_id", "ref"]).select("image_id", "star", "ref", F.round("d2", 6).alias("d2"))


_NEAREST = f"""d AS ({ad.DETECTIONS}), r AS ({ad.REFERENCES}), j AS (SELECT image_id, star, ref, (x - rx) ** 2 + (y - ry) ** 2 AS d2 FROM d JOIN r USING (image_id)),
n AS (SELECT image_id, star, ref, d2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id, star ORDER BY d2, ref) AS rn FROM j WHERE d2 <= {RADIUS**2}) WHERE rn = 1),
m AS (SELECT image_id, star, ref, d2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ref ORDER BY d2, star) AS rn FROM n) WHERE rn = 1)"""


def residual_rms(spark: SparkSession, d: str) -> DataFrame:
    pairs = mutual_best(_nearest(spark, d), ["star"], ["image_id", "ref"])
    return im.rms(pairs).select("image_id", "pairs", F.round("rms", 6).alias("rms"))


def sigma_clip_round(spark: SparkSession, d: str) -> DataFrame:
    pairs = mutual_best(_nearest(spark, d), ["star"], ["image_id", "ref"]).withColumn("d2", F.when(F.col("star") % 5 == 0, F.col("d2") * 4).otherwise(F.col("d2")))
    return im.sigma_clip(pairs).select("image_id", "star", "ref")


def model_selection(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    models = li.groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("sip_order")).agg(F.avg("l_discount").alias("rms"))
    return im.simplest_model(models)


def doubtful_solutions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    pairs, refs = (key % 60).cast("double"), (key % 400 + 1).cast("double")
    chance = im.chance_pairs(refs, F.lit(300.0), F.lit(3.0), F.lit(1600.0), F.lit(1200.0))
    verdict = im.doubtful(pairs, refs, F.col("l_discount") * 30, F.col("l_quantity") * 2, chance)
    return li.groupBy(verdict.alias("doubtful")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(chance), 4).alias("chance"))


def verify_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    d2 = F.when(F.col("event_type") != "error", F.col("value") / 40)
    odds = im.evidence(d2, F.lit(2.0), F.lit(0.008))
    rows = e.select("user_id", "event_id", F.round(odds, 9).alias("log_odds"))
    return im.verify(rows, ("user_id",), ("event_id",)).select("user_id", "accepted", F.round("best", 5).alias("best"), "used")


def _verify_sql() -> str:
    return """WITH e AS (SELECT user_id, event_id, round(CASE WHEN event_type <> 'error' AND value IS NOT NULL THEN ln(0.25 + 0.75 * (exp(-(value / 40) / 4) / (4 * pi())) / 0.008) ELSE ln(0.25) END, 9) AS o FROM events),
s AS (SELECT *, sum(o) OVER w AS s, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, greatest(0, max(s) OVER (PARTITION BY user_id ORDER BY i)) AS best FROM s),
g AS (SELECT user_id, min(i) AS stop FROM b WHERE best < 20.72326583694641 AND s < -13.815510557964274 GROUP BY user_id)
SELECT user_id, (max(stop) IS NULL AND max(best) >= 20.72326583694641) AS accepted, round(max(best), 5) AS best, count(*) AS used FROM b LEFT JOIN g USING (user_id) WHERE stop IS NULL OR i <= stop GROUP BY user_id"""


def fit_plane(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares plane rx = a + b x + c y over the matched pairs of each image, in closed form."""
    pairs = mutual_best(_nearest(spark, d), ["star"], ["image_id", "ref"])
    basis = [F.lit(1.0), (F.col("x") - 800) / 1000, (F.col("y") - 600) / 1000]
    eq = im.normal_equations(pairs, basis, (F.col("rx") - 800) / 1000).where("a_0_0 >= 4")
    a = {c: F.col(c) for c in eq.columns if c.startswith("a_")}
    x = im.solve3(a, tuple(F.col(f"b_{k}") for k in range(3)))
    return eq.select("image_id", F.col("a_0_0").cast("long").alias("n"), *(F.round(v, 5).alias(k) for k, v in zip(("a", "b", "c"), x)))


def _fit_sql() -> str:
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    base = [["n", "u", "v"], ["u", "uu", "uv"], ["v", "uv", "vv"]]
    b = ["t", "ut", "vt"]
    cols = ", ".join(f"round({det([[b[i] if j == k else base[i][j] for j in range(3)] for i in range(3)])} / {det(base)}, 5) AS {'abc'[k]}" for k in range(3))
    return f"""WITH {_NEAREST}, q AS (SELECT image_id, (x - 800) / 1000 AS p, (y - 600) / 1000 AS o, (rx - 800) / 1000 AS z FROM m JOIN d USING (image_id, star) JOIN r USING (image_id, ref)),
s AS (SELECT image_id, count(*) AS n, sum(p) AS u, sum(o) AS v, sum(p * p) AS uu, sum(p * o) AS uv, sum(o * o) AS vv, sum(z) AS t, sum(p * z) AS ut, sum(o * z) AS vt FROM q GROUP BY image_id HAVING count(*) >= 4)
SELECT image_id, n, {cols} FROM s"""


def search_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.col("event_id") % 7).alias("quads"), F.sum(F.col("event_id") % 3).alias("candidates"), F.bool_or(F.col("user_id") % 50 == 0).alias("timed_out"))


QUERIES = {f.__name__: f for f in (tile_background, tile_median_filter, smoothed_peaks, pixel_binning, thumbnail_reduce, stretch_stats, max_pixel, median_fwhm, compact_stars, concentrated_stars, point_sources, top_stars, even_sample, nearest_within_radius, mutual_match, residual_rms, sigma_clip_round, model_selection, doubtful_solutions, verify_fold, fit_plane, search_statistics)}

_KEPT = "WITH d AS ({0}), k AS (SELECT *, {1} AS keep FROM d{2}) SELECT image_id, star FROM (SELECT *, sum(keep::int) OVER (PARTITION BY image_id) AS n FROM k) WHERE keep OR n < 4"
_CHANCE = f"(k % 400 + 1) * least(1, 300 * {math.pi!r}::double * 9 / 1920000)"
ORACLES = {
    "tile_background": f"WITH {_TILES}, f AS (SELECT image_id, {MED.format('sigma')} AS m FROM b GROUP BY image_id) SELECT image_id, tile_x, tile_y, round(median, 6) AS median, round(greatest(sigma, 0.25 * m, 1e-6), 6) AS sigma FROM b JOIN f USING (image_id)",
    "tile_median_filter": f"WITH {_TILES} SELECT b.image_id, b.tile_x, b.tile_y, round({MED.format('n.median')}, 6) AS median, round({MED.format('n.sigma')}, 6) AS sigma FROM b JOIN b n ON n.image_id = b.image_id AND abs(n.tile_x - b.tile_x) <= 1 AND abs(n.tile_y - b.tile_y) <= 1 GROUP BY b.image_id, b.tile_x, b.tile_y",
    "smoothed_peaks": _PEAKS,
    "pixel_binning": f"WITH p AS ({ad.PIXELS}) SELECT image_id, x // 5 AS x, y // 5 AS y, round(sum(v), 4) AS v FROM p WHERE x < 60 AND y < 45 GROUP BY ALL",
    "thumbnail_reduce": f"WITH p AS ({ad.PIXELS}) SELECT image_id, x * 10 // 64 AS x, y * 7 // 48 AS y, round(avg(v) + 1e-7, 4) AS v FROM p GROUP BY image_id, x * 10 // 64, y * 7 // 48",
    "stretch_stats": _STRETCH,
    "max_pixel": f"SELECT image_id, max(v) AS brightest, round(0.95 * max(v), 6) AS saturation, count(*) AS n FROM ({ad.PIXELS}) GROUP BY image_id",
    "median_fwhm": f"SELECT image_id, round({MED.format('fwhm')}, 6) AS median_fwhm FROM ({ad.DETECTIONS}) GROUP BY image_id",
    "compact_stars": _KEPT.format(f"SELECT image_id, star, concentration, CASE WHEN star % 3 = 0 THEN fwhm * 5 ELSE fwhm END AS fwhm FROM ({ad.DETECTIONS})", "fwhm <= 4 * m OR concentration >= 0.9", f" JOIN (SELECT image_id, {MED.format('fwhm')} AS m FROM d GROUP BY image_id) USING (image_id)"),
    "concentrated_stars": _KEPT.format(ad.DETECTIONS, "concentration >= 0.6", ""),
    "point_sources": f"WITH d AS (SELECT * FROM ({ad.DETECTIONS}) WHERE concentration >= 0.9), w AS (SELECT image_id, list_sort(list(fwhm))[least(count(*) - 1, floor(count(*) * 0.1::double)::int) + 1] AS w FROM d GROUP BY image_id), s AS (SELECT image_id, star, concentration * flux / (fwhm * fwhm) AS peak FROM d JOIN w USING (image_id) WHERE fwhm <= 1.5 * w) SELECT image_id, star, rank, round(peak, 6) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY peak DESC, star) - 1 AS rank FROM s) WHERE rank < 50",
    "top_stars": f"SELECT image_id, star, rank, flux FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY flux DESC, star) - 1 AS rank FROM ({ad.DETECTIONS}) WHERE NOT saturated) WHERE rank < 100",
    "even_sample": f"WITH s AS (SELECT image_id, star, row_number() OVER (PARTITION BY image_id ORDER BY flux DESC, star) - 1 AS rank FROM ({ad.DETECTIONS}) WHERE snr >= 20 AND NOT saturated), t AS (SELECT * FROM s WHERE rank < 1000), n AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM t) SELECT image_id, star, rank FROM n WHERE n <= 50 OR rank IN (SELECT k * n // 50 FROM range(50) r(k))",
    "nearest_within_radius": f"WITH {_NEAREST} SELECT image_id, star, ref, round(d2, 6) AS d2 FROM n",
    "mutual_match": f"WITH {_NEAREST} SELECT image_id, star, ref, round(d2, 6) AS d2 FROM m",
    "residual_rms": f"WITH {_NEAREST} SELECT image_id, count(*) AS pairs, round(sqrt(avg(d2)), 6) AS rms FROM m GROUP BY image_id",
    "sigma_clip_round": f"WITH {_NEAREST}, q AS (SELECT image_id, star, ref, CASE WHEN star % 5 = 0 THEN d2 * 4 ELSE d2 END AS d2 FROM m), s AS (SELECT image_id, {MED.format('sqrt(d2)')} AS m, count(*) AS n FROM q GROUP BY image_id) SELECT image_id, star, ref FROM q JOIN s USING (image_id) WHERE n < 8 OR sqrt(d2) <= greatest(3 * m / 1.1774, 0.2)",
    "model_selection": "WITH m AS (SELECT l_suppkey AS image_id, l_linenumber AS sip_order, avg(l_discount) AS rms FROM lineitem GROUP BY ALL) SELECT image_id, min(sip_order) AS sip_order FROM m JOIN (SELECT image_id, min(rms) AS b FROM m GROUP BY image_id) USING (image_id) WHERE rms <= 1.03 * b GROUP BY image_id",
    "doubtful_solutions": f"WITH k AS (SELECT *, l_orderkey * 8 + l_linenumber AS k FROM lineitem), c AS (SELECT k % 60 AS pairs, k % 400 + 1 AS refs, l_discount * 30 AS rms, l_quantity * 2 AS odds, {_CHANCE} AS chance FROM k) SELECT CASE WHEN pairs < 5 * chance THEN true WHEN pairs >= 30 AND pairs >= 20 * chance THEN false ELSE pairs < 0.2 * refs AND (rms > 1.5 OR odds < 50) END AS doubtful, count(*) AS n, round(sum(chance), 4) AS chance FROM c GROUP BY 1",
    "verify_fold": _verify_sql(),
    "fit_plane": _fit_sql(),
    "search_statistics": "SELECT event_type, sum(event_id % 7)::bigint AS quads, sum(event_id % 3)::bigint AS candidates, bool_or(user_id % 50 = 0) AS timed_out FROM events GROUP BY event_type",
}

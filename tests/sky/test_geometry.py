import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skyquilt.functions import sphere
from skyquilt.functions import text as tx
from skyquilt.functions import wcs as wf
from skyquilt.functions.quadcode import bins_for
from skyquilt.functions.text import round_half_up
from skyquilt.operators import enrich, fits, pyramid
from skyquilt.operators.grid import RingGrid
from skyquilt.sources.catalogs import CHUNK_DIVISOR, brightest_of_chunks
from tests.sky import synthetic


def test_cells_and_cones(spark):
    rng = np.random.default_rng(1)
    n = 4000
    points = pd.DataFrame({"id": np.arange(n), "ra": rng.random(n) * 2 * math.pi, "dec": np.arcsin(2 * rng.random(n) - 1), "mag": 1.0})
    cones = pd.DataFrame({"cone": np.arange(40), "cone_ra": rng.random(40) * 2 * math.pi, "cone_dec": np.arcsin(2 * rng.random(40) - 1), "cone_radius": rng.choice([0.005, 0.02, 0.12], 40)})
    cones.loc[:3, "cone_dec"] = [math.pi / 2, -math.pi / 2, 1.56, -1.55]
    cones.loc[4:6, "cone_ra"] = [0.0, 6.2831, 0.001]
    v = lambda a, d: np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=-1)
    near = np.linalg.norm(v(cones.cone_ra.values, cones.cone_dec.values)[:, None] - v(points.ra.values, points.dec.values)[None], axis=2) <= 2 * np.sin(cones.cone_radius.values / 2)[:, None]
    want = {(int(c), int(p)) for c, p in zip(*np.nonzero(near))}
    for size in (0.3, 2.0, 7.0):
        grid = RingGrid(math.radians(size))
        df = grid.with_cell(spark.createDataFrame(points))
        got = {(r.cone, r.id) for r in grid.cone_join(spark.createDataFrame(cones), df).select("cone", "id").collect()}
        assert got == want
        c = cones.iloc[7]
        one = {r.id for r in grid.cone_filter(df, float(c.cone_ra), float(c.cone_dec), float(c.cone_radius)).collect()}
        assert one == {p for q, p in want if q == 7}


def test_cells_of_similar_area(spark):
    grid = RingGrid(math.radians(12))
    n = 60000
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"ra": rng.random(n) * 2 * math.pi, "dec": np.arcsin(2 * rng.random(n) - 1)}))
    counts = [r["count"] for r in grid.with_cell(df).groupBy("cell").count().collect()]
    assert len(counts) == grid.cells and 0.5 < min(counts) / np.mean(counts) and max(counts) / np.mean(counts) < 1.6


def test_pyramid_holds_every_star_once(spark):
    stars = spark.createDataFrame(synthetic.sky(3000))
    rows, grids = pyramid.build_pyramid(stars, pyramid.PyramidOptions(min_cell_deg=4))
    got = pyramid.positions(rows).select("id", "level", "cell", "rn", "pos", "mag").toPandas().sort_values("pos")
    assert sorted(got.id) == list(range(3000)) and list(got.pos) == list(range(3000))
    assert (got.groupby(["level", "cell"]).size()[got.level.unique()[:-1].tolist()] <= 4).all()
    assert got.sort_values(["level", "cell", "rn"]).pos.is_monotonic_increasing and len(grids) == got.level.nunique()
    assert pyramid.build_pyramid(stars.limit(0))[0].count() == 0


def test_sphere_round_trips(spark):
    df = spark.createDataFrame(synthetic.sky(300))
    plane = sphere.TangentPlane.at(F.col("ra") + 0.1, F.col("dec") * 0.9)
    v = sphere.to_vector(F.col("ra"), F.col("dec"))
    back = plane.unproject(plane.xi(v), plane.eta(v))
    r = df.select(sphere.separation(F.col("ra"), F.col("dec"), sphere.ra_of(back[0], back[1]), sphere.dec_of(back[2])).alias("s"), sphere.wrap(F.col("ra") - 20).alias("w"), (sphere.chord2_to_angle(sphere.angle_to_chord2(F.col("ra") / 3)) - F.col("ra") / 3).alias("c")).toPandas()
    assert r.s.max() < 1e-7 and r.w.between(0, 2 * math.pi).all() and r.c.abs().max() < 1e-9
    pole = sphere.TangentPlane.at_vector(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert spark.range(1).select(*pole.e, *pole.n).first() == (0.0, 1.0, 0.0, -1.0, 0.0, 0.0)


def test_wcs_with_sip_matches_the_kernel(spark):
    w = synthetic.true_wcs(120, 60, 60, 20, False)
    a, b = np.zeros((4, 4)), np.zeros((4, 4))
    a[2, 0], a[1, 1], b[0, 2], b[2, 1] = 2e-6, -1e-6, 3e-6, 1e-9
    w = fits.Wcs(w.crpix, w.center, w.cd, 3, a, b).with_inverse(1600, 1200)
    cd = np.degrees(w.cd)
    row = {"crpix_x": w.crpix[0], "crpix_y": w.crpix[1], "crval_ra": 120.0, "crval_dec": 60.0, "cd11": float(cd[0, 0]), "cd12": float(cd[0, 1]), "cd21": float(cd[1, 0]), "cd22": float(cd[1, 1]), "sip_order": 3, "a": a.ravel().tolist(), "b": b.ravel().tolist(), "ap": w.ap.ravel().tolist(), "bp": w.bp.ravel().tolist()}
    xy = [(float(x), float(y)) for x in (0, 400, 1599) for y in (0, 700, 1199)]
    df = spark.createDataFrame([(x, y, row) for x, y in xy], f"x double, y double, w {wf.WCS_TYPE}")
    df = df.withColumn("s", wf.pixel_to_sky(F.col("w"), F.col("x"), F.col("y"))).withColumn("p", wf.sky_to_pixel(F.col("w"), F.col("s.ra"), F.col("s.dec")))
    vec = w.vectors(*np.array(xy).T)
    for r, v in zip(df.collect(), vec):
        assert abs(r.p.x - r.x) < 1e-3 and abs(r.p.y - r.y) < 1e-3
        assert abs(r.s.dec - math.degrees(math.asin(v[2]))) < 1e-8
    keys = [k.key for k in df.select(wf.keywords(F.col("w")).alias("k")).first().k]
    assert keys[:2] == ["CTYPE1", "CTYPE2"] and "A_2_0" in keys and "A_0_2" not in keys and "AP_ORDER" in keys
    behind = spark.createDataFrame([(row,)], f"w {wf.WCS_TYPE}").select(wf.sky_to_pixel(F.col("w"), F.lit(300.0), F.lit(-60.0)).alias("p")).first().p
    assert behind is None or behind.x is None


def test_fits_of_world_coordinates():
    rng = np.random.default_rng(5)
    w = synthetic.true_wcs(310, -89.9, 30, -60, True)
    x, y = rng.uniform(0, 1600, 60), rng.uniform(0, 1200, 60)
    got = fits.fit_linear(x, y, w.vectors(x, y), w.crpix, w.center + 0.01)
    px, py = got.pixels(w.vectors(x, y))
    assert np.abs(np.r_[px - x, py - y]).max() < 1e-6
    a, b = np.zeros((4, 4)), np.zeros((4, 4))
    a[2, 0], b[0, 3] = 1e-6, 2e-9
    w = fits.Wcs(w.crpix, w.center, w.cd, 3, a, b)
    x, y = rng.uniform(0, 1600, 300), rng.uniform(0, 1200, 300)
    vec = w.vectors(x + rng.normal(0, 0.05, 300), y + rng.normal(0, 0.05, 300))
    linear = fits.fit_linear(x, y, vec, w.crpix, w.center)
    got = fits.fit_sip(x, y, vec, linear, 3, 1600, 1200)
    assert np.linalg.norm(got.vectors(x, y) - w.vectors(x, y), axis=1).max() / sphere.ARCSEC < 1.5
    assert fits.fit_sip(x[:5], y[:5], vec[:5], linear, 3, 1600, 1200) is None
    assert fits.fit_linear(np.zeros(5), np.zeros(5), vec[:5], w.crpix, w.center) is None


def test_detection_and_gaussian_fit():
    rng = np.random.default_rng(8)
    yy, xx = np.mgrid[:220, :300]
    a = 1000 + 0.05 * xx + 0.02 * yy + rng.normal(0, 8, xx.shape)
    truth = [(40.3, 50.7, 3000), (120.5, 80.2, 9000), (200.1, 150.9, 1500), (260.8, 30.4, 30000), (150.0, 190.0, 800)]
    for x, y, p in truth:
        a += p * np.exp(-0.5 * ((xx - x) ** 2 + (yy - y) ** 2) / 1.4**2)
    a[100, 20] = 60000  # a hot pixel
    s = fits.detect(a)
    assert np.all(np.diff(s[:, 2]) <= 0)
    for x, y, _ in truth:
        assert np.hypot(s[:, 0] - x, s[:, 1] - y).min() < 0.25
    assert np.hypot(s[:, 0] - 20, s[:, 1] - 100).min() > 5
    p, fwhm = fits.fit_gaussian(a[73:88, 113:128] - 1000)
    assert abs(fwhm - 1.4 * 2.3548) < 0.1 and abs(p[2] + 113 - 120.5) < 0.05
    assert len(fits.detect(np.zeros((10, 10)))) == 0


def test_text_functions(spark):
    rows = spark.createDataFrame([("12:30:00",), ("-5d 30m",), ("-0:30",), ("+10.5",), ("x",), ("1:2:3:4",), (None,), ("  7h  ",)], "t string")
    got = [r.v for r in rows.select(tx.parse_angle(F.col("t")).alias("v")).collect()]
    assert got == [12.5, -5.5, -0.5, 10.5, None, None, None, 7.0]
    f = spark.createDataFrame([(359.9999999, -0.00001), (83.8, -5.4), (0.0, 90.0)], "a double, d double").select(tx.format_ra(F.col("a")).alias("a"), tx.format_dec(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in f] == [("00:00:00.00", "+00:00:00.0"), ("05:35:12.00", "-05:24:00.0"), ("00:00:00.00", "+90:00:00.0")]
    n = spark.createDataFrame([("ngc0224",), ("Sh2-101",), ("M 31",), ("vdb 12",), ("what",)], "t string").select(tx.normalize_designation(F.col("t")).alias("n")).collect()
    assert [r.n for r in n] == ["NGC 224", "Sh2-101", "M 31", "vdB 12", None]
    p = spark.range(1).select(tx.pascal_number(F.lit(123.45)).alias("a"), tx.pascal_number(F.lit(-1e-5), 5).alias("b")).first()
    assert p.a.startswith(" 1.2345") and p.a.endswith("E+002") and p.b == "-1.0000E-005"


def test_precession():
    m = np.array(sphere.precession_matrix(2000.0, 1875.0))
    assert np.allclose(m @ m.T, np.eye(3), atol=1e-12)
    assert np.allclose(np.array(sphere.precession_matrix(1875.0, 2000.0)) @ m, np.eye(3), atol=1e-7)


def test_wide_camera():
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    for mirrored in (False, True):
        d = rng.uniform(-700, 700, (4, 2))
        v = np.column_stack([d[:, 0], -d[:, 1] if mirrored else d[:, 1], np.full(4, 900.0)])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        f, r, m, error = fits.fit_camera(v @ q.T, d + [799.5, 599.5], (799.5, 599.5), 820.0)
        assert abs(f - 900) < 0.5 and m == mirrored and np.allclose(r, q, atol=1e-3) and error < 1e-3
        assert fits.fit_camera(v @ q.T, d + [799.5, 599.5], (799.5, 599.5), 400.0) is None


def test_level_for_an_area():
    cumulative = [100, 1_000, 10_000]
    assert [pyramid.level_for(cumulative, 4 * math.pi * share, 50) for share in (1, 0.5, 0.4, 0.04, 0.001)] == [0, 0, 1, 2, 2]


def test_ranks_of_unknown_magnitudes_come_last(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 4.0), (4, None)], "id long, mag double")
    assert {r.id: r.rank for r in pyramid.brightness_rank(df).collect()} == {3: 0, 1: 1, 2: 2, 4: 3}


def test_bounded_chunks_and_rounding(spark):
    rows = [(k * CHUNK_DIVISOR + i, float((i * 7) % 10)) for k in (0, 5) for i in range(10)]
    got = brightest_of_chunks(spark.createDataFrame(rows, "source_id long, mag double"), 3).collect()
    assert sorted((r.chunk, r.mag) for r in got) == [(0, 0.0), (0, 1.0), (0, 2.0), (5, 0.0), (5, 1.0), (5, 2.0)]
    assert spark.range(1).select(round_half_up(F.lit(2.345), 100.0).alias("x")).first().x == 2.35
    assert [bins_for(n) for n in (1, 1_000_000, 10**9)] == [16, 28, 64]


def test_requests_are_clamped(spark):
    df = spark.range(6000).select(F.col("id").alias("prominence"))
    assert enrich.page(df, 9000).agg(F.max("prominence"), F.max("total")).first()[:] == (5000, 6000)
    assert enrich.page(df, -3).agg(F.max("prominence")).first()[0] == 1

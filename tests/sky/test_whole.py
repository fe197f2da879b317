"""Queries over their whole table, against brute force on the smallest tables."""

import os
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt import catalog
from skyquilt.functions import wcs as wf
from skyquilt.functions.sphere import rounded
from skyquilt.operators import enrich, rangejoin
from skyquilt.plans import adapters as ad
from skyquilt.plans import sky
from skyquilt.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def run(spark, name):
    return catalog.QUERIES[name](spark, DATA)


def vectors(ra, dec):
    return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=-1)


def test_tangent_projection_of_all_stars(spark):
    stars = ad.stars(spark, DATA).toPandas()
    got = run(spark, "tangent_projection").toPandas().set_index("id").sort_index()
    c = vectors(0.7, 0.3)
    want = stars[vectors(stars.ra, stars.dec) @ c > 0.2].set_index("id").sort_index()
    assert list(got.index) == list(want.index) and (got.index % 5 != 0).any()
    assert np.abs(got.ra - want.ra).max() < 1e-6 and np.abs(got.dec - want.dec).max() < 1e-6
    v = vectors(want.ra, want.dec)
    e = np.array([-np.sin(0.7), np.cos(0.7), 0])
    assert np.abs(got.xi - v @ e / (v @ c)).max() < 1e-6 and np.abs(got.eta - v @ np.cross(c, e) / (v @ c)).max() < 1e-6


@pytest.mark.parametrize("name", ["wcs_pixels", "wcs_cards", "plate_keywords", "result_ini", "image_outline", "text_report", "result_json"])
def test_one_result_an_order(spark, name):
    got = run(spark, name)
    key = "o_orderkey" if "o_orderkey" in got.columns else "id"
    orders = {r[0] for r in table(spark, DATA, "orders").select("o_orderkey").collect()}
    per = got.groupBy(key).count().collect()
    assert {r[0] for r in per} == orders and len({r[1] for r in per}) == 1


def test_whole_tables_meet_aggregates_and_joins(spark):
    assert run(spark, "matches_csv").agg({"n": "sum"}).first()[0] == table(spark, DATA, "lineitem").count()
    parts = Counter(r[0] for r in table(spark, DATA, "orders").select("o_custkey").collect())
    names = {r[0] for r in table(spark, DATA, "customer").select("c_custkey").collect()}
    assert {r["name"]: r.parts for r in run(spark, "installed_left_join").collect()} == {f"gaia-{k}": parts[k] for k in names}


def test_aliases_of_all_parts(spark):
    df = spark.createDataFrame([("b", f"t{k}", k) for k in range(1500)], "key string, name string, k long")
    assert enrich.aliases(df, "key", "name", "k").first().aliases == ";".join(f"t{k}" for k in range(1, 1500))
    want: dict[str, dict] = {}
    for r in table(spark, "/root/testdata/sf0.01", "part").orderBy("p_partkey").collect():
        want.setdefault(r.p_brand, {})[r.p_type] = None
    got = catalog.QUERIES["object_aliases"](spark, "/root/testdata/sf0.01").collect()
    assert {r.p_brand: [r.first_name, *r.aliases.split(";")] for r in got} == {b: list(t) for b, t in want.items()}


def brute_quads(ids, v, low, high):
    """Sets of stars of all quads: pairs AB, and C, D in the circle on AB in the tangent plane at its middle."""
    out = []
    for i in range(len(ids)):
        sep = 2 * np.arcsin(np.linalg.norm(v - v[i], axis=1) / 2)
        for j in np.flatnonzero((sep >= low) & (sep < high)):
            if j <= i:
                continue
            m = v[i] + v[j]
            m /= np.linalg.norm(m)
            e = np.array([-m[1], m[0], 0]) / np.hypot(m[0], m[1])
            w = v @ m
            z = (v @ e + 1j * (v @ np.cross(m, e))) / w
            t = (z - z[i]) / (z[j] - z[i])
            inside = [k for k in np.flatnonzero((w > 0) & (np.abs(t) ** 2 - t.real <= 0)) if k not in (i, j)]
            out += [(tuple(sorted((ids[i], ids[j]))), tuple(sorted((ids[k], ids[n])))) for k, n in combinations(inside, 2)]
    return sorted(out)


def test_every_quad_of_level_0(spark):
    stars = sky.pyramid.one_level(ad.stars(spark, DATA), sky.RingGrid(sky.COARSE), 0, 4)[0].toPandas()
    got = sorted((tuple(sorted((r.a, r.b))), tuple(sorted((r.c, r.d)))) for r in run(spark, "quads_uncapped").collect())
    want = brute_quads(stars.id.tolist(), vectors(stars.ra.to_numpy(), stars.dec.to_numpy()), sky.QUAD_LOW, sky.QUAD_HIGH)
    assert got == want and any(k % 16 for ab, cd in got for k in ab + cd)


@pytest.mark.parametrize("spread", [3.0, 0.06])
def test_closest_in_a_dense_sky_against_brute_force(spark, monkeypatch, spread):
    """The same as all pairs give, from a number of pairs in proportion to the rows; copies and poles among them."""
    rng = np.random.default_rng(5)
    reach, n, m = 60 * enrich.ARCMIN, 6000, 400
    ra, dec = rng.uniform(0, 0.3, n) * spread, np.where(np.arange(n) % 4 == 0, np.pi / 2 - rng.uniform(0, 0.02, n), rng.uniform(-0.05, 0.05, n) * spread)
    ra[::3], dec[::3] = ra[0], dec[0]
    major = [None if i % 7 == 0 else float(2 * rng.integers(1, 51)) for i in range(n)]
    ora, odec, size = rng.uniform(0, 0.3, m) * spread, np.where(np.arange(m) % 5 == 0, np.pi / 2 - rng.uniform(0, 0.02, m), rng.uniform(-0.05, 0.05, m) * spread), rng.integers(0, 90, m).astype(float)
    base = spark.createDataFrame([(i, float(ra[i]), float(dec[i]), major[i]) for i in range(n)], "id long, ra double, dec double, major double")
    other = spark.createDataFrame([(i, float(ora[i]), float(odec[i]), float(size[i])) for i in range(m)], "oid long, ra double, dec double, size double")
    met, join = [], enrich.range_join

    def counted(left, right, axes, residual, *more):
        met.append(join(left, right, axes, F.lit(True), *more).count())
        return join(left, right, axes, residual, *more)

    monkeypatch.setattr(enrich, "range_join", counted)
    got = {r.oid: r.id3 for r in enrich.closest(base, other, reach).collect()}
    dist = 2 * np.arcsin(np.linalg.norm(vectors(ra, dec)[None] - vectors(ora, odec)[:, None], axis=2) / 2)
    own = np.maximum(np.array([1.0 if x is None else x for x in major])[None], size[:, None]) * enrich.ARCMIN / 2 + reach / 4
    score = np.where(dist <= np.minimum(reach, own), dist / own, np.inf)
    want = {i: int(np.flatnonzero(score[i] <= score[i].min() * (1 + 1e-12))[0]) for i in range(m) if np.isfinite(score[i].min())}
    assert got == want and len(want) > 100
    assert sum(met) < m * n / 20 and enrich.closest(base.limit(0), other, reach).count() == 0


def test_nearest_sends_the_many_once_against_brute_force(spark, monkeypatch):
    """The nearest of few positions for many, at the radius exactly and below zero; the many are not multiplied before the join."""
    rng = np.random.default_rng(8)
    xy, pq, image = rng.integers(-200, 200, (3000, 2)) / 4.0, rng.integers(-200, 200, (200, 2)) / 4.0, rng.integers(0, 3, 3200)
    left = spark.createDataFrame([(int(image[i]), i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "image_id long, star long, x double, y double")
    right = spark.createDataFrame([(int(image[3000 + i]), i, float(p), float(q)) for i, (p, q) in enumerate(pq)], "image_id long, ref long, rx double, ry double")
    sent, join = {}, rangejoin.range_join

    def counted(l, r, axes, *more):
        touched = 1
        for t in rangejoin._cells(axes)[1]:
            touched = touched * F.size(t)
        sent.update({l.columns[1]: l.count(), r.columns[1]: r.agg(F.sum(touched)).first()[0]})
        return join(l, r, axes, *more)

    monkeypatch.setattr(rangejoin, "range_join", counted)
    got = {r.star: (r.ref, r.d2) for r in rangejoin.nearest(left, right, ("x", "rx"), ("y", "ry"), 5.0, "star", ["ref"], ["image_id"]).collect()}
    d2 = np.where(image[:3000, None] == image[None, 3000:], ((xy[:, None] - pq[None]) ** 2).sum(axis=2), np.inf)
    assert got == {i: (int(d2[i].argmin()), float(d2[i].min())) for i in range(3000) if d2[i].min() <= 25} and any(v[1] == 25 for v in got.values())
    assert sent["star"] == 3000 and sent["ref"] < 3 * 200


def test_outlines_by_plain_columns(spark):
    """Once an image and by plain columns the same as pixel by pixel; no lambda is left, which Spark would interpret."""
    assert "lambda" not in catalog.QUERIES["image_outline"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    w = wf.linear(F.lit(99.5), F.lit(49.5), F.col("id") * 37.0, F.col("id") * 20.0 - 90, (F.lit(-0.01), F.lit(0.002), F.lit(0.002), F.lit(0.01)))
    plates = spark.range(10).select("id", w.alias("w"))
    slow = plates.select("id", "w", F.posexplode(wf.outline(F.lit(200), F.lit(100))).alias("k", "p")).select("id", "k", wf.pixel_to_sky(F.col("w"), F.col("p.x"), F.col("p.y")).alias("s")).select("id", "k", "s.ra", "s.dec")
    assert sorted(wf.with_outline(plates, "w", wf.outline_points(200, 100)).collect()) == sorted(slow.collect())


def test_rounded_as_spark_rounds(spark):
    rng = np.random.default_rng(2)
    ties = [k / 1e6 + s * 5e-7 + e for k in (0, 1, 7, 123456, 359999999) for s in (-1, 1) for e in (0, 1e-12, -1e-12)]
    values = [0.0, -0.0, 1e-9, -1e-9, 1e9 + 0.1, -1e300, float("inf"), float("-inf"), float("nan"), None, *ties, *(-t for t in ties), *rng.uniform(-360, 360, 20000).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b"))
    assert [repr(r.a) for r in df.collect()] == [repr(r.b) for r in df.collect()]

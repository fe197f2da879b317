import math

import numpy as np
import pandas as pd
import pytest

from skyquilt.operators import pyramid, quads, solve
from skyquilt.operators.grid import RingGrid
from skyquilt.plans import solver as plan
from tests.sky import synthetic

SIZES = [16.0, 16 / math.sqrt(2), 8.0, 8 / math.sqrt(2)]


@pytest.fixture(scope="module")
def index(spark):
    stars = synthetic.sky(20000)
    df = spark.createDataFrame(stars)
    levels = pyramid.fixed_levels(df, SIZES, 6).select("id", "ra", "dec", "mag", "level", "cell", "rn").cache()
    q = quads.build(levels, [RingGrid(math.radians(z)) for z in SIZES], quads.QuadOptions(quads_per_cell=12, low=0.3, high=1.0)).cache()
    grid = RingGrid(math.radians(4))
    in_cells = grid.with_cell(levels.select("id", "ra", "dec", "mag")).cache()
    return stars, in_cells, grid, solve.located(q, levels.select("id", "ra", "dec")).cache()


def test_golden_fields(spark, index):
    stars, in_cells, grid, located = index
    truth = {i: synthetic.true_wcs(*c) for i, c in enumerate(synthetic.CASES)}
    det = pd.concat([synthetic.star_list(stars, w, i) for i, w in truth.items()] + [synthetic.star_list(stars, truth[0], 100, missing=0.25, spurious=100)])
    rng = np.random.default_rng(3)
    junk = pd.DataFrame({"image_id": 200, "rank": np.arange(100), "x": rng.uniform(0, 1600, 100), "y": rng.uniform(0, 1200, 100)})
    det = spark.createDataFrame(pd.concat([det, junk]))
    sizes = det.select("image_id").distinct().selectExpr("image_id", "1600 as width", "1200 as height")
    got = {r.image_id: r for r in solve.solve_pass(det, sizes, in_cells, grid, located).collect()}
    assert 200 not in got
    assert set(got) >= {0, 1, 2, 3, 4, 5}
    truth[100] = truth[0]
    for i, r in got.items():
        w = truth[i]
        case = synthetic.CASES[0 if i == 100 else i]
        assert abs(r.scale / case[2] - 1) < 1e-3 and r.pairs >= 10 and r.flipped == (np.linalg.det(w.cd) > 0)
        found = solve.fits.Wcs((r.wcs.crpix_x, r.wcs.crpix_y), np.array([math.cos(math.radians(r.wcs.crval_dec)) * math.cos(math.radians(r.wcs.crval_ra)), math.cos(math.radians(r.wcs.crval_dec)) * math.sin(math.radians(r.wcs.crval_ra)), math.sin(math.radians(r.wcs.crval_dec))]), np.radians([[r.wcs.cd11, r.wcs.cd12], [r.wcs.cd21, r.wcs.cd22]]))
        mid = np.array([800.0]), np.array([600.0])
        x, y = w.pixels(found.vectors(*mid))
        assert np.hypot(x - 800, y - 600)[0] < 0.3


def few_images(spark, stars, cases=(0, 4)):
    det = spark.createDataFrame(pd.concat([synthetic.star_list(stars, synthetic.true_wcs(*synthetic.CASES[i]), i) for i in cases]))
    return det, det.select("image_id").distinct().selectExpr("image_id", "1600 as width", "1200 as height")


def test_hypotheses_beyond_the_first_block_are_verified(spark, index, monkeypatch):
    stars, in_cells, grid, located = index
    det, sizes = few_images(spark, stars)
    real = solve.candidates

    def behind_false_ones(*args):
        """All candidates, behind 60 an image of better residual that lie elsewhere."""
        found = real(*args)
        false = found.withColumns({"px": -found.px, "py": -found.py, "pz": -found.pz, "residual": found.residual * 0})
        return found.unionByName(false.dropDuplicates(["image_id"]).crossJoin(spark.range(60)).drop("id"))

    monkeypatch.setattr(solve, "candidates", behind_false_ones)
    got = solve.solve_pass(det, sizes, in_cells, grid, located).collect()
    assert sorted(r.image_id for r in got) == [0, 4]


def test_next_hypothesis_when_refinement_rejects_the_best(spark, index, monkeypatch):
    stars, in_cells, grid, located = index
    det, sizes = few_images(spark, stars)
    real, calls = solve.refined, []

    def rejecting(*args):
        calls.append(1)
        return real(*args).where("true" if len(calls) > 1 else "false")

    monkeypatch.setattr(solve, "refined", rejecting)
    got = solve.solve_pass(det, sizes, in_cells, grid, located).collect()
    assert sorted(r.image_id for r in got) == [0, 4]


def test_depth_of_stages():
    assert [(s.name, s.stars) for s in plan.stages()] == [("compact", 32), ("all", 32), ("concentrated", 100), ("more", 100), ("loose", 50)]
    assert {s.stars for s in plan.stages(wide_diagonal_px=2000.0) if s.focal} == {100}


def test_image_whose_brightest_detections_are_no_stars(spark, index):
    stars, in_cells, grid, located = index
    det = synthetic.star_list(stars, synthetic.true_wcs(*synthetic.CASES[0]), 0)
    rng = np.random.default_rng(5)
    knots = pd.DataFrame({"image_id": 0, "rank": 0, "x": rng.uniform(0, 1600, 40), "y": rng.uniform(0, 1200, 40)})
    det = pd.concat([knots, det], ignore_index=True)
    det = spark.createDataFrame(det.assign(rank=np.arange(len(det))))
    sizes = det.select("image_id").distinct().selectExpr("image_id", "1600 as width", "1200 as height")
    solver = object.__new__(plan.Solver)
    solver.__dict__.update(stars=in_cells, grid=grid, index=located, options=solve.SolverOptions())
    got = solver.solve(det, sizes).collect()
    assert [(r.image_id, round(r.scale)) for r in got] == [(0, synthetic.CASES[0][2])]


def test_every_nation_gives_a_field(spark):
    fields = plan._fields(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.image_id for r in fields) == list(range(25)) and all(abs(r.w.crval_dec) <= 90 for r in fields)


def test_detected_images_and_star_widths(spark):
    rng = np.random.default_rng(8)
    yy, xx = np.mgrid[:128, :160]
    a = 500 + rng.normal(0, 5, xx.shape)
    truth = [(20 + 13 * k, 15 + 11 * (k % 9), 2000 + 300 * k) for k in range(10)]
    for x, y, p in truth:
        a += p * np.exp(-0.5 * ((xx - x) ** 2 + (yy - y) ** 2) / 1.5**2)
    images = spark.createDataFrame([(7, 160, 128, 1, a.astype("<f4").tobytes())], "image_id long, width int, height int, binning int, data binary")
    det = solve.detect_images(images).cache()
    rows = det.orderBy("rank").collect()
    assert len(rows) >= 9 and [r.flux for r in rows] == sorted((r.flux for r in rows), reverse=True)
    w = solve.star_widths(det, images).first()
    assert abs(w.fwhm - 1.5 * 2.3548) < 0.2

"""Plate solving of star lists in batches: every step runs over all images at once.

Quads of the brightest detections of each image, in all orders noise allows,
meet the index's quads in a four-dimensional range join; candidates are fitted,
their fields gathered by a cone join, and the log-odds of catalog stars with and
without counterparts folded.  Hypotheses are verified in blocks, until an image
is solved or has none left; the best one that refinement accepts counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.quadcode import quantize_x, quantize_y
from skyquilt.functions.sphere import ARCSEC, to_vector
from skyquilt.operators import fits, images, quads
from skyquilt.operators.grid import RingGrid
from skyquilt.operators.rangejoin import Axis, nearest, range_join
from skyquilt.session import cut


@dataclass(frozen=True)
class SolverOptions:
    #: detections that make quads, at first and at full depth, and members of a quad's circle
    stars: int = 32
    most_stars: int = 100
    members: int = 10
    tolerance: float = 0.01
    #: hypotheses of an image that are verified at once, best residuals first; later blocks are larger
    hypotheses: int = 40
    min_scale: float = 0.0
    max_scale: float = 1e9
    position_error: float = 1.5
    max_sip: int = 5


def image_quads(detections: DataFrame, options: SolverOptions = SolverOptions()) -> DataFrame:
    """Quads of the brightest detections (``image_id, rank, x, y``) with their codes in canonical order."""
    top = detections.where(F.col("rank") < options.stars).select("image_id", "rank", "x", "y")

    def enumerate_quads(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        z = rows["x"].to_numpy() + 1j * rows["y"].to_numpy()
        tol, out = options.tolerance, []
        for a, b in combinations(range(len(z)), 2):
            if abs(z[b] - z[a]) < 20:
                continue
            t = (z - z[a]) / (z[b] - z[a])
            inside = [k for k in range(len(z)) if k not in (a, b) and abs(t[k]) ** 2 - t[k].real <= tol * (1 + tol)][: options.members]
            for c, d in combinations(inside, 2):
                out.append((rows["image_id"].iloc[0], max(a, b, c, d), a, b, c, d, *(float(f(z[k])) for k in (a, b, c, d) for f in (np.real, np.imag)), t[c].real, t[c].imag, t[d].real, t[d].imag))
        return pd.DataFrame(out, columns=["image_id", "faintest", "a", "b", "c", "d", "ax", "ay", "bx", "by", "cx", "cy", "dx", "dy", "cr", "ci", "dr", "di"])

    return top.groupBy("image_id").applyInPandas(enumerate_quads, "image_id long, faintest int, a int, b int, c int, d int, ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double, cr double, ci double, dr double, di double")


def located(quads_: DataFrame, stars: DataFrame) -> DataFrame:
    """Index quads with the unit vectors of their stars: ``vx0 .. vz3``."""
    x, y, z = to_vector(F.col("ra"), F.col("dec"))
    out = quads_
    for k, star in enumerate("abcd"):
        v = stars.select(F.col("id").alias(star), x.alias(f"vx{k}"), y.alias(f"vy{k}"), z.alias(f"vz{k}"))
        out = out.join(v, star)
    return out


def candidates(image: DataFrame, index: DataFrame, options: SolverOptions = SolverOptions()) -> DataFrame:
    """Image quads and index quads whose codes agree, with the similarity that maps one to the other.

    ``index`` is :func:`located`.  A mirrored image has the conjugate code.
    """
    units = options.tolerance * 65535
    probes = quads.orderings(image, options.tolerance)
    q = [quantize_x(F.col("q0")), quantize_y(F.col("q1")), quantize_x(F.col("q2")), quantize_y(F.col("q3"))]
    probes = probes.withColumns({f"q{k}": c for k, c in enumerate(q)}).withColumn("quad", F.monotonically_increasing_id())
    codes = index.select(F.col("cx").alias("i0"), F.col("cy").alias("i1"), F.col("dx").alias("i2"), F.col("dy").alias("i3"), F.struct("a", "b", "c", "d").alias("index_quad"), (F.col("checks") if "checks" in index.columns else F.array().cast("array<double>")).alias("checks"), *(f"v{p}{k}" for k in range(4) for p in "xyz"))
    d2 = sum(((F.col(f"i{k}") - F.col(f"q{k}")).cast("double") * (F.col(f"i{k}") - F.col(f"q{k}")) for k in range(1, 4)), (F.col("i0") - F.col("q0")).cast("double") * (F.col("i0") - F.col("q0")))
    # sizes of what Python makes are not known to Spark, which would broadcast any number of rows
    pairs = range_join(codes.hint("merge"), probes.hint("merge"), [Axis(f"i{k}", f"q{k}", units, 2 * units) for k in range(4)], d2 <= units * units)
    keep = ["image_id", "quad", "faintest", "checks", "swap_ab", "swap_cd", "mirrored", "ax", "ay", "bx", "by", "cx", "cy", "dx", "dy", *(f"v{p}{k}" for k in range(4) for p in "xyz")]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = [b[f"{s}x"].to_numpy() + 1j * b[f"{s}y"].to_numpy() for s in "abcd"]
            ab, cd = b["swap_ab"].to_numpy(bool), b["swap_cd"].to_numpy(bool)
            z = np.stack([np.where(ab, z[1], z[0]), np.where(ab, z[0], z[1]), np.where(cd, z[3], z[2]), np.where(cd, z[2], z[3])], axis=1)
            z = np.where(b["mirrored"].to_numpy(bool)[:, None], z.conj(), z)
            v = np.stack([[b[f"v{p}{k}"].to_numpy() for p in "xyz"] for k in range(4)]).transpose(2, 0, 1)
            # where the check stars of the index quad, given relative to its A and B, are in the image
            checks = []
            for k, za, zb, m in zip(b["checks"], z[:, 0], z[:, 1], b["mirrored"]):
                t = za + (zb - za) * (np.asarray(k[0::2], float) + 1j * np.asarray(k[1::2], float))
                checks.append(np.stack([t.real, -t.imag if m else t.imag], axis=1).ravel().tolist())
            c = v.sum(axis=1)
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            h = np.maximum(np.hypot(c[:, 0], c[:, 1]), 1e-15)
            e = np.stack([-c[:, 1] / h, c[:, 0] / h, 0 * h], axis=1)
            n = np.cross(c, e)
            dot = np.einsum("nij,nj->ni", v, c)
            s = (np.einsum("nij,nj->ni", v, e) + 1j * np.einsum("nij,nj->ni", v, n)) / dot
            zm, sm = z.mean(axis=1, keepdims=True), s.mean(axis=1, keepdims=True)
            alpha = ((s - sm) * (z - zm).conj()).sum(axis=1) / (np.abs(z - zm) ** 2).sum(axis=1)
            beta = sm[:, 0] - alpha * zm[:, 0]
            scale = np.abs(alpha) / ARCSEC
            residual = np.sqrt((np.abs(alpha[:, None] * z + beta[:, None] - s) ** 2).mean(axis=1)) / np.abs(alpha)
            r2 = (np.abs(z - zm) ** 2).mean(axis=1)
            out = pd.DataFrame({"image_id": b["image_id"], "quad": b["quad"], "faintest": b["faintest"], "mirrored": b["mirrored"], "px": c[:, 0], "py": c[:, 1], "pz": c[:, 2], "alpha_r": alpha.real, "alpha_i": alpha.imag, "beta_r": beta.real, "beta_i": beta.imag, "scale": scale, "residual": residual, "quad_x": zm[:, 0].real, "quad_y": np.where(b["mirrored"], -zm[:, 0].imag, zm[:, 0].imag), "quad_r2": r2, "checks": checks, "check_radius": 2 * options.position_error + options.tolerance * np.abs(z[:, 1] - z[:, 0])})
            yield out[(residual < 3 * options.position_error) & (scale >= options.min_scale) & (scale <= options.max_scale)]

    return pairs.select(*keep).mapInPandas(fit, "image_id long, quad long, faintest int, mirrored boolean, px double, py double, pz double, alpha_r double, alpha_i double, beta_r double, beta_i double, scale double, residual double, quad_x double, quad_y double, quad_r2 double, checks array<double>, check_radius double")


def _pixel(ra: str = "ra", dec: str = "dec") -> tuple:
    """Pixel of a star under a similarity hypothesis; null behind its plane."""
    v = to_vector(F.col(ra), F.col(dec))
    p = [F.col(c) for c in ("px", "py", "pz")]
    h = F.sqrt(p[0] * p[0] + p[1] * p[1])
    e = (-p[1] / h, p[0] / h)
    dot = p[0] * v[0] + p[1] * v[1] + p[2] * v[2]
    xi = (e[0] * v[0] + e[1] * v[1]) / dot
    eta = (-p[2] * e[1] * v[0] + p[2] * e[0] * v[1] + (p[0] * e[1] - p[1] * e[0]) * v[2]) / dot
    a2 = F.col("alpha_r") * F.col("alpha_r") + F.col("alpha_i") * F.col("alpha_i")
    u, w = xi - F.col("beta_r"), eta - F.col("beta_i")
    x, y = (u * F.col("alpha_r") + w * F.col("alpha_i")) / a2, (w * F.col("alpha_r") - u * F.col("alpha_i")) / a2
    return F.when(dot > 0.1, x), F.when(dot > 0.1, F.when(F.col("mirrored"), -y).otherwise(y))


def gathered(hypotheses: DataFrame, sizes: DataFrame, stars: DataFrame, grid: RingGrid, margin: float = 0.0) -> DataFrame:
    """Catalog stars in the image of each hypothesis, with their pixels ``sx, sy``.  ``stars`` has ``cell`` on ``grid``."""
    h = hypotheses.join(sizes, "image_id")
    dx, dy = F.greatest("quad_x", F.col("width") - F.col("quad_x")), F.greatest("quad_y", F.col("height") - F.col("quad_y"))
    reach = F.sqrt(dx * dx + dy * dy) * (1 + margin)
    h = h.withColumns({"cone_ra": F.pmod(F.atan2("py", "px"), F.lit(2 * math.pi)), "cone_dec": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("pz")))), "cone_radius": F.atan(F.col("scale") * ARCSEC * reach) * 1.02})
    x, y = _pixel()
    near = grid.cone_join(h, stars.select("id", "ra", "dec", "mag", "cell")).withColumns({"sx": x, "sy": y})
    m = margin * F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height"))
    return near.where((F.col("sx") >= -m) & (F.col("sy") >= -m) & (F.col("sx") <= F.col("width") - 1 + m) & (F.col("sy") <= F.col("height") - 1 + m))


def brightest(seen: DataFrame, detections: DataFrame, times: float) -> DataFrame:
    """Of the catalog stars of each hypothesis, the brightest: ``times`` as many as the image has detections."""
    count = detections.groupBy("image_id").agg(F.count(F.lit(1)).alias("__count"))
    w = Window.partitionBy("image_id", "hypothesis").orderBy("mag", "star_id")
    placed = seen.withColumn("__place", F.row_number().over(w)).join(count, "image_id")
    return placed.where(F.col("__place") <= times * F.col("__count")).drop("__place", "__count")


def verified(hypotheses: DataFrame, detections: DataFrame, sizes: DataFrame, stars: DataFrame, grid: RingGrid, options: SolverOptions = SolverOptions()) -> DataFrame:
    """Hypotheses with ``accepted`` and ``best`` log-odds."""
    seen = gathered(hypotheses, sizes, stars, grid)
    d2 = (F.col("sx") - F.col("quad_x")) * (F.col("sx") - F.col("quad_x")) + (F.col("sy") - F.col("quad_y")) * (F.col("sy") - F.col("quad_y"))
    e2 = options.position_error**2
    variance = e2 * (1.25 + d2 / F.col("quad_r2")) + 1e-6 * d2
    # every star of the image takes part in the count of the brightest, near the quad or not
    seen = seen.withColumn("variance", variance).withColumn("inside", F.col("variance") <= 16 * e2).withColumn("radius", 3 * F.sqrt("variance"))
    seen = cut(brightest(seen.select("image_id", "hypothesis", F.col("id").alias("star_id"), "mag", "sx", "sy", "variance", "radius", "inside"), detections, 1.0))
    seen = seen.where("inside").drop("inside")
    key = F.concat_ws(":", "hypothesis", "star_id")
    lit = detections.select("image_id", F.col("rank").alias("found"), "x", "y")
    met = nearest(seen.withColumn("key", key), lit, ("sx", "x"), ("sy", "y"), "radius", "key", ["found"], ["image_id"], "left", width=6 * options.position_error)
    density = detections.groupBy("image_id").agg(F.count(F.lit(1)).alias("count")).join(sizes, "image_id").select("image_id", (F.col("count") / (F.col("width") * F.col("height"))).alias("density"))
    odds = met.join(density, "image_id").withColumn("log_odds", images.evidence(F.col("d2"), F.col("variance"), F.col("density")))
    told = images.verify(odds, ("image_id", "hypothesis"), ("mag", "star_id"))
    return hypotheses.join(told, ["image_id", "hypothesis"])


def refine_kernel(det: pd.DataFrame, ref: pd.DataFrame, width: int, height: int, options: SolverOptions) -> dict | None:
    """World coordinates of one image from its detections and the catalog stars of a hypothesis."""
    x, y = det["x"].to_numpy(), det["y"].to_numpy()
    ra, dec = ref["ra"].to_numpy(), ref["dec"].to_numpy()
    vec = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)
    sx, sy, variance = ref["sx"].to_numpy(), ref["sy"].to_numpy(), ref["variance"].to_numpy()
    crpix = ((width - 1) / 2, (height - 1) / 2)

    def match(px: np.ndarray, py: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each star with its nearest reference, each reference with its closest star."""
        d2 = (px[None, :] - x[:, None]) ** 2 + (py[None, :] - y[:, None]) ** 2
        k = d2.argmin(axis=1)
        best = d2[np.arange(len(x)), k]
        ok = np.flatnonzero(best <= radius[k] ** 2)
        order = ok[np.argsort(best[ok], kind="stable")]
        _, first = np.unique(k[order], return_index=True)
        stars = order[np.sort(first)]
        return stars, k[stars]

    def residuals(w: fits.Wcs, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.linalg.norm(w.vectors(x[s], y[s]) - vec[r], axis=1) / (w.scale * ARCSEC)

    def fitted(s: np.ndarray, r: np.ndarray, order: int, start: np.ndarray) -> tuple[fits.Wcs | None, np.ndarray, np.ndarray]:
        w = None
        for _ in range(3):
            if len(s) < 4:
                return None, s, r
            w = fits.fit_linear(x[s], y[s], vec[r], crpix, start)
            if w is not None and order >= 2:
                w = fits.fit_sip(x[s], y[s], vec[r], w, order, width, height) or w
            if w is None or len(s) < 8:
                break
            e = residuals(w, s, r)
            keep = e <= max(3 * np.sort(e)[len(e) // 2] / 1.1774, 0.2)
            if keep.all():
                break
            s, r = s[keep], r[keep]
        return w, s, r

    s, r = match(sx, sy, 3 * np.sqrt(variance))
    if len(s) < 4:
        return None
    wcs, s, r = fitted(s, r, 0, vec[r].sum(axis=0))
    if wcs is None:
        return None
    radius = 4 * options.position_error

    def again(w: fits.Wcs, order: int) -> tuple[fits.Wcs | None, np.ndarray, np.ndarray]:
        px, py = w.pixels(vec)
        return fitted(*match(px, py, np.full(len(px), radius)), order, w.center)

    rms_of = lambda w, s, r: float(np.sqrt((residuals(w, s, r) ** 2).mean()))
    for _ in range(2):
        w, s2, r2 = again(wcs, 0)
        if w is None:
            break
        wcs, s, r = w, s2, r2
        radius = max(2 * options.position_error, min(radius, 3 * rms_of(wcs, s, r) + 0.5))
    models = [(wcs, s, r, rms_of(wcs, s, r))]
    for order in range(2, options.max_sip + 1):
        if len(models[-1][1]) < fits.min_stars_for_sip(order):
            break
        w, s2, r2 = again(models[-1][0], order)
        if w is None:
            break
        models.append((w, s2, r2, rms_of(w, s2, r2)))
    least = min(m[3] for m in models)
    wcs, s, r, _ = next(m for m in models if m[3] <= 1.03 * least)
    for _ in range(2):
        radius = max(1.0, min(radius, 3 * rms_of(wcs, s, r) + 0.5))
        w, s2, r2 = again(wcs, wcs.order)
        if w is None:
            break
        wcs, s, r = w, s2, r2
    if len(s) < min(8, max(5, len(x) // 2)):
        return None
    px, py = wcs.pixels(vec)
    refs = int(((px >= 0) & (py >= 0) & (px <= width - 1) & (py <= height - 1)).sum())
    rms = float(np.sqrt((residuals(wcs, s, r) ** 2).mean()))
    chance = refs * min(1.0, len(x) * math.pi * radius**2 / (width * height))
    odds = float(ref["best"].iloc[0])
    convincing = len(s) >= 30 and len(s) >= 20 * chance
    if len(s) < 5 * chance or (not convincing and len(s) < 0.2 * refs and (rms > 1.5 or odds < 50)):
        return None
    wcs.with_inverse(width, height)
    center = wcs.vectors(np.array([crpix[0]]), np.array([crpix[1]]))[0]
    cd = np.degrees(wcs.cd)
    flat = lambda a: None if a is None or wcs.order < 2 else a.ravel().tolist()
    crval = np.degrees([math.atan2(wcs.center[1], wcs.center[0]) % (2 * math.pi), math.asin(wcs.center[2])])
    return {
        "ra": math.degrees(math.atan2(center[1], center[0]) % (2 * math.pi)), "dec": math.degrees(math.asin(center[2])), "scale": wcs.scale,
        "rotation": math.degrees(math.atan2(cd[0, 1], cd[1, 1])), "flipped": bool(np.linalg.det(cd) > 0), "pairs": len(s), "rms_px": rms, "log_odds": odds,
        "wcs": {"crpix_x": crpix[0], "crpix_y": crpix[1], "crval_ra": crval[0], "crval_dec": crval[1], "cd11": cd[0, 0], "cd12": cd[0, 1], "cd21": cd[1, 0], "cd22": cd[1, 1], "sip_order": wcs.order, "a": flat(wcs.a), "b": flat(wcs.b), "ap": flat(wcs.ap), "bp": flat(wcs.bp)},
        "matched": [{"x": float(x[i]), "y": float(y[i]), "star": int(ref["star_id"].iloc[j])} for i, j in zip(s, r)],
    }


SOLUTION = "image_id long, ra double, dec double, scale double, rotation double, flipped boolean, pairs int, rms_px double, log_odds double, wcs struct<crpix_x:double,crpix_y:double,crval_ra:double,crval_dec:double,cd11:double,cd12:double,cd21:double,cd22:double,sip_order:int,a:array<double>,b:array<double>,ap:array<double>,bp:array<double>>, matched array<struct<x:double,y:double,star:long>>"


def refined(chosen: DataFrame, detections: DataFrame, sizes: DataFrame, stars: DataFrame, grid: RingGrid, options: SolverOptions = SolverOptions()) -> DataFrame:
    """Solutions of images: of the chosen hypotheses of each, the one of most log-odds that the kernel
    does not find doubtful."""
    seen = gathered(chosen, sizes, stars, grid, 0.05)
    d2 = (F.col("sx") - F.col("quad_x")) * (F.col("sx") - F.col("quad_x")) + (F.col("sy") - F.col("quad_y")) * (F.col("sy") - F.col("quad_y"))
    variance = options.position_error**2 * (1.25 + d2 / F.col("quad_r2")) + 1e-6 * d2
    refs = brightest(seen.select("image_id", "hypothesis", F.col("id").alias("star_id"), "mag", "ra", "dec", "sx", "sy", variance.alias("variance"), "best", "width", "height"), detections, 2.0)
    refs = refs.drop("mag")

    def one(det: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        names = ["image_id", "hypothesis", "ra", "dec", "scale", "rotation", "flipped", "pairs", "rms_px", "log_odds", "wcs", "matched"]
        if not len(det) or not len(ref):
            return pd.DataFrame([], columns=names)
        found = refine_kernel(det.sort_values("rank"), ref, int(ref["width"].iloc[0]), int(ref["height"].iloc[0]), options)
        return pd.DataFrame([{"image_id": det["image_id"].iloc[0], "hypothesis": det["of"].iloc[0], **found}] if found else [], columns=names)

    lit = detections.select("image_id", "rank", "x", "y").join(chosen.select("image_id", F.col("hypothesis").alias("of")), "image_id")
    found = lit.groupBy("image_id", "of").cogroup(refs.groupBy("image_id", "hypothesis")).applyInPandas(one, SOLUTION.replace(",", ", hypothesis int,", 1))
    first = Window.partitionBy("image_id").orderBy(F.col("log_odds").desc(), "hypothesis")
    return found.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn", "hypothesis")


def solve_pass(detections: DataFrame, sizes: DataFrame, stars: DataFrame, grid: RingGrid, index: DataFrame, options: SolverOptions = SolverOptions(), checked: bool = True) -> DataFrame:
    """One pass over all images.  ``index``: located quads; ``stars``: with ``cell`` on ``grid``.

    Every candidate whose check stars do not speak against it is verified, in blocks of rank over the
    images still unsolved; each block is four times the one before, so the loop is short.  Not ``checked``:
    wide fields, whose check stars are too far from the quad for its similarity.
    """
    found = candidates(image_quads(detections, options), index, options)
    w = Window.partitionBy("image_id").orderBy("residual", "faintest", "quad", "px")
    ranked = cut(found.withColumn("quad", F.row_number().over(w)))
    if checked:
        points = F.transform(F.sequence(F.lit(0), (F.size("checks") / 2).cast("int") - 1), lambda k: F.struct(F.get("checks", 2 * k).alias("kx"), F.get("checks", 2 * k + 1).alias("ky")))
        checks = ranked.where(F.size("checks") > 0).select("image_id", "quad", F.col("check_radius").alias("kr"), F.explode(points).alias("p")).select("image_id", "quad", "kr", "p.*")
        ranked = checks_present(ranked, checks, detections, sizes, checks.agg(F.max("kr")).first()[0] or 5.0)
    ranked = cut(ranked.withColumn("hypothesis", F.row_number().over(Window.partitionBy("image_id").orderBy("quad"))).drop("checks", "check_radius"))
    first = Window.partitionBy("image_id").orderBy(F.col("best").desc(), "hypothesis")
    solved, low, size = None, 0, options.hypotheses
    while solved is None or not ranked.where(F.col("hypothesis") > low).isEmpty():
        block = cut(ranked.where((F.col("hypothesis") > low) & (F.col("hypothesis") <= low + size)))
        told = verified(block, detections, sizes, stars, grid, options).where("accepted")
        told = cut(told.withColumn("__rn", F.row_number().over(first)))
        # the best accepted hypothesis of each image; where refinement rejects it, the others
        for turn in ("__rn = 1", "__rn > 1"):
            got = cut(refined(told.where(turn).drop("__rn"), detections, sizes, stars, grid, options))
            solved = got if solved is None else solved.unionByName(got)
            told = cut(told.join(got.select("image_id"), "image_id", "left_anti"))
            ranked = ranked.join(got.select("image_id"), "image_id", "left_anti")
            if told.isEmpty():
                break
        ranked, low, size = cut(ranked), low + size, size * 4
    return solved


def detect_images(images_: DataFrame, threshold: float = 5.0, most: int = 1000) -> DataFrame:
    """Detections of decoded images (``image_id, width, height, binning, data``), in source pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, w, h, b, data in zip(*(batch[c] for c in ("image_id", "width", "height", "binning", "data"))):
                s = fits.detect(np.frombuffer(data, "<f4").reshape(h, w).astype(float), threshold, most)
                half = (b - 1) / 2
                yield pd.DataFrame({"image_id": i, "rank": np.arange(len(s)), "x": s[:, 0] * b + half, "y": s[:, 1] * b + half, "flux": s[:, 2], "fwhm": s[:, 3] * b, "concentration": s[:, 4], "snr": s[:, 5], "saturated": s[:, 6] > 0})

    return images_.where("data is not null").select("image_id", "width", "height", "binning", "data").mapInPandas(run, "image_id long, rank int, x double, y double, flux double, fwhm double, concentration double, snr double, saturated boolean")


def star_widths(matched: DataFrame, images_: DataFrame, most: int = 50, half: int = 8) -> DataFrame:
    """``image_id, fwhm``: median width in pixels of Gaussian fits to at most ``most`` evenly spaced
    matched stars (``image_id, x, y, snr, saturated, fwhm``; unsaturated, snr of 20 or more).

    Images with under 5 fits have the median of their measured widths instead.
    """
    good = matched.where(~F.col("saturated") & (F.col("snr") >= 20))
    some = images.even_sample(good, most, "snr")

    def fit(stars: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        widths = []
        if len(image) and len(stars):
            r = image.iloc[0]
            a = np.frombuffer(r["data"], "<f4").reshape(r["height"], r["width"]).astype(float)
            for x, y in zip(stars["x"], stars["y"]):
                i, j = int(round(x)), int(round(y))
                stamp = a[max(0, j - half) : j + half + 1, max(0, i - half) : i + half + 1]
                found = fits.fit_gaussian(stamp) if min(stamp.shape) >= 7 else None
                if found and 0.5 < found[1] < 2 * half:
                    widths.append(found[1])
        if len(widths) < 5:
            widths = list(stars["fwhm"])
        out = [(stars["image_id"].iloc[0], float(sorted(widths)[len(widths) // 2]))] if widths else []
        return pd.DataFrame(out, columns=["image_id", "fwhm"])

    return some.groupBy("image_id").cogroup(images_.select("image_id", "width", "height", "data").groupBy("image_id")).applyInPandas(fit, "image_id long, fwhm double")


def checks_present(found: DataFrame, checks: DataFrame, detections: DataFrame, sizes: DataFrame, radius: float = 5.0) -> DataFrame:
    """Candidates one of whose check stars is detected, or none of whose lie in the image.

    ``checks``: ``image_id, quad, kx, ky``, the pixels where check stars should be, and how near in ``kr``
    if that is less than ``radius``.
    """
    if "kr" not in checks.columns:
        checks = checks.withColumn("kr", F.lit(radius))
    inside = checks.join(sizes, "image_id").where((F.col("kx") >= 0) & (F.col("ky") >= 0) & (F.col("kx") <= F.col("width") - 1) & (F.col("ky") <= F.col("height") - 1)).select("image_id", "quad", "kx", "ky", "kr")
    lit = detections.select("image_id", "x", "y")
    d2 = (F.col("kx") - F.col("x")) * (F.col("kx") - F.col("x")) + (F.col("ky") - F.col("y")) * (F.col("ky") - F.col("y"))
    seen = range_join(lit.hint("merge"), inside.hint("merge"), [Axis("x", "kx", radius), Axis("y", "ky", radius)], d2 <= F.col("kr") * F.col("kr"), ["image_id"]).select("image_id", "quad").distinct()
    absent = inside.select("image_id", "quad").distinct().join(seen.hint("merge"), ["image_id", "quad"], "left_anti")
    return found.join(absent.hint("merge"), ["image_id", "quad"], "left_anti")

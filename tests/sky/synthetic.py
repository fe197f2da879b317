"""Synthetic skies and star lists with a known truth."""

import math

import numpy as np
import pandas as pd

from skyquilt.operators import fits

WIDTH, HEIGHT = 1600, 1200

#: ra, dec (degrees), scale (arcsec a pixel), rotation (degrees), flipped
CASES = [(83.8, -5.4, 60, 30, False), (0.02, 12, 75, -170, True), (359.9, -45, 50, 95, False), (200, 89.6, 60, 10, False), (310, -89.9, 70, -60, True), (45, 20, 100, 45, True)]


def sky(n, seed=42):
    rng = np.random.default_rng(seed)
    u = rng.random(n)
    return pd.DataFrame({"id": np.arange(n), "ra": rng.random(n) * 2 * math.pi, "dec": np.arcsin(2 * rng.random(n) - 1), "mag": 12 + np.log10(np.maximum(1e-9, u)) / 0.5, "pm_ra": 0.0, "pm_dec": 0.0})


def true_wcs(ra, dec, scale, rotation, flipped):
    a, d, r, s = math.radians(ra), math.radians(dec), math.radians(rotation), scale / 206264.806247
    c = np.array([math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)])
    cd = s * np.array([[-math.cos(r), math.sin(r)], [math.sin(r), math.cos(r)]])
    if flipped:
        cd[:, 0] *= -1
    return fits.Wcs(((WIDTH - 1) / 2, (HEIGHT - 1) / 2), c, cd)


def star_list(stars, wcs, image_id, noise=0.2, count=150, missing=0.0, spurious=0, seed=1):
    rng = np.random.default_rng(seed + image_id)
    v = np.stack([np.cos(stars.dec) * np.cos(stars.ra), np.cos(stars.dec) * np.sin(stars.ra), np.sin(stars.dec)], axis=1)
    front = v @ wcs.center > 0.3
    x, y = wcs.pixels(v[front])
    rows = stars[front].assign(x=x, y=y)
    rows = rows[(x >= 0) & (y >= 0) & (x <= WIDTH - 1) & (y <= HEIGHT - 1)].sort_values("mag").head(count)
    rows = rows[rng.random(len(rows)) >= missing]
    rows = rows.assign(x=rows.x + rng.normal(0, noise, len(rows)), y=rows.y + rng.normal(0, noise, len(rows)))
    fake = pd.DataFrame({"mag": rng.uniform(rows.mag.min(), rows.mag.max(), spurious), "x": rng.uniform(0, WIDTH, spurious), "y": rng.uniform(0, HEIGHT, spurious)})
    rows = pd.concat([rows[["mag", "x", "y"]], fake]).sort_values("mag").reset_index(drop=True)
    return pd.DataFrame({"image_id": image_id, "rank": np.arange(len(rows)), "x": rows.x, "y": rows.y})

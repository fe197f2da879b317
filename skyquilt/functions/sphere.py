"""Spherical geometry as column expressions (radians unless a name says degrees)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
HALF_PI = math.pi / 2
ARCSEC = math.pi / 180 / 3600
MAS = ARCSEC / 1000


def frac(x: Column) -> Column:
    return x - F.floor(x)


def rounded(x: Column, digits: int) -> Column:
    """``F.round``, with the same results, but by way of decimal text only near ties, for large values and for none."""
    y = x * F.lit(10.0**digits)
    plain = F.abs(y - F.floor(y) - 0.5).between(1e-4, 0.5) & (F.abs(y) < 1e10)
    return F.when(plain, F.floor(y + 0.5) / F.lit(10.0**digits)).otherwise(F.round(x, digits))


def wrap(ra: Column) -> Column:
    """A right ascension in [0, 2 pi)."""
    return ra - F.lit(TWO_PI) * F.floor(ra / F.lit(TWO_PI))


def to_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)


def ra_of(x: Column, y: Column) -> Column:
    a = F.atan2(y, x)
    return F.when(a < 0, a + F.lit(TWO_PI)).otherwise(a)


def dec_of(z: Column) -> Column:
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Haversine distance of two positions."""
    s, t = F.sin((dec2 - dec1) / 2), F.sin((ra2 - ra1) / 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(s * s + F.cos(dec1) * F.cos(dec2) * t * t)))


def chord2_to_angle(chord2: Column) -> Column:
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(chord2) / 2))


def angle_to_chord2(angle: Column) -> Column:
    return 4 * F.sin(angle / 2) * F.sin(angle / 2)


def moved(ra: Column, dec: Column, pm_ra: Column, pm_dec: Column, years: Column | float) -> tuple[Column, Column]:
    """Position after proper motion in mas a year, of which the one in right ascension holds cos(dec)."""
    years = F.lit(years) if not isinstance(years, Column) else years
    still = ((pm_ra == 0) & (pm_dec == 0)) | (years == 0)
    east = pm_ra * F.lit(MAS) * years / F.greatest(F.cos(dec), F.lit(1e-6))
    return F.when(still, ra).otherwise(wrap(ra + east)), F.when(still, dec).otherwise(dec + pm_dec * F.lit(MAS) * years)


@dataclass(frozen=True)
class TangentPlane:
    """Gnomonic projection about a point: centre, east and north unit vectors."""

    c: tuple[Column, Column, Column]
    e: tuple[Column, Column, Column]
    n: tuple[Column, Column, Column]

    @classmethod
    def at(cls, ra: Column, dec: Column) -> TangentPlane:
        return cls.at_vector(*to_vector(ra, dec))

    @classmethod
    def at_vector(cls, x: Column, y: Column, z: Column) -> TangentPlane:
        """At the poles east is the y axis."""
        r = F.sqrt(x * x + y * y + z * z)
        x, y, z = x / r, y / r, z / r
        h = F.sqrt(x * x + y * y)
        pole = h < 1e-12
        ex = F.when(pole, F.lit(0.0)).otherwise(-y / h)
        ey = F.when(pole, F.lit(1.0)).otherwise(x / h)
        return cls((x, y, z), (ex, ey, F.lit(0.0)), (-z * ey, z * ex, x * ey - y * ex))

    def dot(self, v: tuple[Column, Column, Column]) -> Column:
        return sum((a * b for a, b in zip(self.c[1:], v[1:])), self.c[0] * v[0])

    def xi(self, v: tuple[Column, Column, Column]) -> Column:
        return (self.e[0] * v[0] + self.e[1] * v[1]) / self.dot(v)

    def eta(self, v: tuple[Column, Column, Column]) -> Column:
        return (self.n[0] * v[0] + self.n[1] * v[1] + self.n[2] * v[2]) / self.dot(v)

    def unproject(self, xi: Column, eta: Column) -> tuple[Column, Column, Column]:
        v = [c + xi * e + eta * n for c, e, n in zip(self.c, self.e, self.n)]
        r = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return v[0] / r, v[1] / r, v[2] / r


def precess(matrix: list[list[float]], ra: Column, dec: Column) -> tuple[Column, Column]:
    """Rotate a position by a literal 3 x 3 matrix."""
    v = to_vector(ra, dec)
    x, y, z = (F.lit(r[0]) * v[0] + F.lit(r[1]) * v[1] + F.lit(r[2]) * v[2] for r in matrix)
    return ra_of(x, y), dec_of(z)


def precession_matrix(from_epoch: float, to_epoch: float) -> list[list[float]]:
    """IAU 1976 precession between two Julian epochs."""
    t0, t = (from_epoch - 2000) / 100, (to_epoch - from_epoch) / 100
    w = 2306.2181 + 1.39656 * t0 - 0.000139 * t0 * t0
    zeta = (w * t + (0.30188 - 0.000344 * t0) * t**2 + 0.017998 * t**3) * ARCSEC
    z = (w * t + (1.09468 + 0.000066 * t0) * t**2 + 0.018203 * t**3) * ARCSEC
    theta = ((2004.3109 - 0.85330 * t0 - 0.000217 * t0 * t0) * t - (0.42665 + 0.000217 * t0) * t**2 - 0.041833 * t**3) * ARCSEC
    cz, sz, cx, sx, ct, st = math.cos(z), math.sin(z), math.cos(zeta), math.sin(zeta), math.cos(theta), math.sin(theta)
    return [[cx * ct * cz - sx * sz, -sx * ct * cz - cx * sz, -st * cz], [cx * ct * sz + sx * cz, -sx * ct * sz + cx * cz, -st * sz], [cx * st, -sx * st, ct]]

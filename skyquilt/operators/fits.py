"""Numpy kernels: world coordinate fits, Gaussian star fits, star detection."""

from __future__ import annotations

import math

import numpy as np


def plane_basis(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """East and north at a unit vector; at the poles east is the y axis."""
    h = math.hypot(c[0], c[1])
    e = np.array([0.0, 1.0, 0.0]) if h < 1e-12 else np.array([-c[1] / h, c[0] / h, 0.0])
    return e, np.cross(c, e)


def project(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e, n = plane_basis(c)
    d = v @ c
    return (v @ e) / d, (v @ n) / d


def unproject(xi: np.ndarray, eta: np.ndarray, c: np.ndarray) -> np.ndarray:
    e, n = plane_basis(c)
    v = c + np.outer(xi, e) + np.outer(eta, n)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def terms(u: np.ndarray, v: np.ndarray, low: int, order: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    powers = [(i, j) for i in range(order + 1) for j in range(order + 1 - i) if i + j >= low]
    return np.stack([u**i * v**j for i, j in powers], axis=1), powers


class Wcs:
    """TAN projection with optional SIP polynomials, in pixels and unit vectors."""

    def __init__(self, crpix: tuple[float, float], center: np.ndarray, cd: np.ndarray, order: int = 0, a: np.ndarray | None = None, b: np.ndarray | None = None):
        self.crpix, self.center, self.cd, self.order = crpix, center, cd, order
        self.a = a if a is not None else np.zeros((order + 1, order + 1))
        self.b = b if b is not None else np.zeros((order + 1, order + 1))
        self.ap = self.bp = None

    def vectors(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        u, v = x - self.crpix[0], y - self.crpix[1]
        if self.order >= 2:
            u, v = u + np.polynomial.polynomial.polyval2d(u, v, self.a), v + np.polynomial.polynomial.polyval2d(u, v, self.b)
        t = self.cd @ np.stack([u, v])
        return unproject(t[0], t[1], self.center)

    def pixels(self, vec: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
        xi, eta = project(vec, self.center)
        u0, v0 = np.linalg.inv(self.cd) @ np.stack([xi, eta])
        u, v = u0, v0
        if self.order >= 2:
            for _ in range(rounds):
                u, v = u0 - np.polynomial.polynomial.polyval2d(u, v, self.a), v0 - np.polynomial.polynomial.polyval2d(u, v, self.b)
        return u + self.crpix[0], v + self.crpix[1]

    @property
    def scale(self) -> float:
        """Arcseconds a pixel."""
        return math.degrees(math.sqrt(abs(np.linalg.det(self.cd)))) * 3600

    def with_inverse(self, width: int, height: int, grid: int = 24) -> Wcs:
        """Inverse polynomials of two orders more, fitted on a grid."""
        if self.order >= 2:
            x, y = (g.ravel() for g in np.meshgrid(np.linspace(0, width - 1, grid), np.linspace(0, height - 1, grid)))
            u, v = x - self.crpix[0], y - self.crpix[1]
            du, dv = np.polynomial.polynomial.polyval2d(u, v, self.a), np.polynomial.polynomial.polyval2d(u, v, self.b)
            s = max(width, height) / 2
            m, powers = terms((u + du) / s, (v + dv) / s, 0, self.order + 2)
            self.ap, self.bp = np.zeros((self.order + 3,) * 2), np.zeros((self.order + 3,) * 2)
            for out, target in ((self.ap, -du), (self.bp, -dv)):
                for (i, j), c in zip(powers, np.linalg.lstsq(m, target, rcond=None)[0]):
                    out[i, j] = c / s ** (i + j)
        return self


def fit_linear(x: np.ndarray, y: np.ndarray, vec: np.ndarray, crpix: tuple[float, float], start: np.ndarray) -> Wcs | None:
    """Linear TAN by rounds of least squares about a moving centre; None if singular."""
    c = start / np.linalg.norm(start)
    m = np.stack([np.ones_like(x), x - crpix[0], y - crpix[1]], axis=1)
    if np.linalg.matrix_rank(m) < 3:
        return None
    cd = np.eye(2)
    for _ in range(8):
        if (vec @ c < 0.05).any():
            return None
        xi, eta = project(vec, c)
        p, q = (np.linalg.lstsq(m, t, rcond=None)[0] for t in (xi, eta))
        cd = np.array([p[1:], q[1:]])
        c = unproject(p[:1], q[:1], c)[0]
        if math.hypot(p[0], q[0]) < 1e-13:
            break
    return Wcs(crpix, c, cd) if abs(np.linalg.det(cd)) > 1e-300 else None


def min_stars_for_sip(order: int) -> int:
    return (order + 1) * (order + 2) // 2 + 3


def fit_sip(x: np.ndarray, y: np.ndarray, vec: np.ndarray, linear: Wcs, order: int, width: int, height: int) -> Wcs | None:
    """SIP polynomials on top of a linear solution, whose linear part is fitted along."""
    if len(x) < min_stars_for_sip(order):
        return None
    xi, eta = project(vec, linear.center)
    s = max(width, height) / 2
    u, v = (x - linear.crpix[0]) / s, (y - linear.crpix[1]) / s
    m, powers = terms(u, v, 0, order)
    fits = [np.linalg.lstsq(m, t, rcond=None)[0] for t in (xi, eta)]
    at = {p: k for k, p in enumerate(powers)}
    cd = np.array([[f[at[1, 0]], f[at[0, 1]]] for f in fits]) / s
    if abs(np.linalg.det(cd)) < 1e-300:
        return None
    center = unproject(np.array([fits[0][at[0, 0]]]), np.array([fits[1][at[0, 0]]]), linear.center)[0]
    inverse = np.linalg.inv(cd)
    a, b = np.zeros((order + 1,) * 2), np.zeros((order + 1,) * 2)
    for (i, j), k in at.items():
        if i + j >= 2:
            a[i, j], b[i, j] = inverse @ np.array([fits[0][k], fits[1][k]]) / s ** (i + j)
    # about the moved centre, the residual shift is taken up by one more linear fit
    moved = Wcs(linear.crpix, center, cd, order, a, b)
    uu, vv = x - linear.crpix[0], y - linear.crpix[1]
    uu, vv = uu + np.polynomial.polynomial.polyval2d(uu, vv, a), vv + np.polynomial.polynomial.polyval2d(uu, vv, b)
    base = fit_linear(uu + linear.crpix[0], vv + linear.crpix[1], vec, linear.crpix, center)
    return Wcs(linear.crpix, base.center, base.cd, order, a, b) if base is not None else moved


def fit_gaussian(stamp: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float] | None:
    """Levenberg-Marquardt fit of an elliptical Gaussian: (base, peak, x, y, sx, sy, angle) and the FWHM."""
    h, w = stamp.shape
    yy, xx = np.mgrid[:h, :w].astype(float)
    base = float(np.median(np.r_[stamp[0], stamp[-1], stamp[:, 0], stamp[:, -1]]))
    p = np.array([base, stamp.max() - base, (w - 1) / 2, (h - 1) / 2, 1.5, 1.5, 0.0])

    def model(p: np.ndarray) -> np.ndarray:
        c, s = math.cos(p[6]), math.sin(p[6])
        a, b = (xx - p[2]) * c + (yy - p[3]) * s, -(xx - p[2]) * s + (yy - p[3]) * c
        return p[0] + p[1] * np.exp(-0.5 * ((a / p[4]) ** 2 + (b / p[5]) ** 2))

    damping, best = 1e-3, float(((stamp - model(p)) ** 2).sum())
    for _ in range(rounds):
        f = model(p)
        jac = np.stack([(model(p + step) - f).ravel() / 1e-5 for step in np.eye(7) * 1e-5], axis=1)
        normal, grad = jac.T @ jac, jac.T @ (stamp - f).ravel()
        try:
            q = p + np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), grad)
        except np.linalg.LinAlgError:
            return None
        q[4:6] = np.clip(np.abs(q[4:6]), 0.3, max(h, w))
        error = float(((stamp - model(q)) ** 2).sum())
        if error < best:
            done = best - error < 1e-9 * best
            p, best, damping = q, error, damping / 10
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return p, 2.3548200450309493 * math.sqrt(p[4] * p[5])


def background(a: np.ndarray, tile: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Background and noise of every pixel: clipped tile medians, a 3 x 3 median, bilinear between tile centres."""
    ny, nx = max(1, round(a.shape[0] / tile)), max(1, round(a.shape[1] / tile))
    ys, xs = np.linspace(0, a.shape[0], ny + 1).astype(int), np.linspace(0, a.shape[1], nx + 1).astype(int)
    med, sig = np.zeros((ny, nx)), np.zeros((ny, nx))
    up = lambda v: np.partition(v, len(v) // 2)[len(v) // 2]
    for j in range(ny):
        for i in range(nx):
            v = a[ys[j] : ys[j + 1], xs[i] : xs[i + 1]].ravel()
            v = v[:: max(1, len(v) // 500)]
            m = up(v)
            s = 1.4826 * up(np.abs(v - m))
            c = v[np.abs(v - m) <= 3 * s]
            if len(c) > 8:
                m = up(c)
                s = 1.4826 * up(np.abs(c - m))
            med[j, i], sig[j, i] = m, s
    sig = np.maximum(sig, max(0.25 * up(sig.ravel().copy()), 1e-6))

    def smooth(t: np.ndarray) -> np.ndarray:
        out = np.empty_like(t)
        for j in range(ny):
            for i in range(nx):
                out[j, i] = up(t[max(0, j - 1) : j + 2, max(0, i - 1) : i + 2].ravel().copy())
        return out

    def spread(t: np.ndarray) -> np.ndarray:
        cy, cx = (ys[:-1] + ys[1:] - 1) / 2, (xs[:-1] + xs[1:] - 1) / 2
        rows = np.stack([np.interp(np.arange(a.shape[1]), cx, r) for r in t])
        if ny == 1:
            return np.repeat(rows, a.shape[0], axis=0)
        at = np.clip(np.interp(np.arange(a.shape[0]), cy, np.arange(ny)), 0, ny - 1)
        low = np.minimum(at.astype(int), ny - 2)
        f = (at - low)[:, None]
        return rows[low] * (1 - f) + rows[low + 1] * f

    return spread(smooth(med)), spread(smooth(sig))


def detect(a: np.ndarray, threshold: float = 5.0, most: int = 1000, by_peak: bool = False) -> np.ndarray:
    """Stars of an image, brightest first: columns x, y, flux, fwhm, concentration, snr, saturated.

    Peaks of the smoothed image over the noise are measured on the background-free
    one; hot pixels and near duplicates of brighter stars are left out.
    """
    none = np.zeros((0, 7))
    if min(a.shape) < 16:
        return none
    back, noise = background(a)
    d = a - back
    k = np.array([1, 4, 6, 4, 1]) / 16
    s = np.apply_along_axis(lambda r: np.convolve(r, k, "same"), 1, d)
    s = np.apply_along_axis(lambda r: np.convolve(r, k, "same"), 0, s)
    c = s[2:-2, 2:-2]
    peak = c >= threshold * noise[2:-2, 2:-2] * 0.28
    for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, -1)):
        peak &= c > s[2 + dy : s.shape[0] - 2 + dy, 2 + dx : s.shape[1] - 2 + dx]
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        peak &= c >= s[2 + dy : s.shape[0] - 2 + dy, 2 + dx : s.shape[1] - 2 + dx]
    ys, xs = np.nonzero(peak)
    ys, xs = ys + 2, xs + 2
    order = np.argsort(-s[ys, xs], kind="stable")[: max(1000, 2 * most)]
    bright = float(a.max()) * 0.95
    out = []
    for y, x in zip(ys[order], xs[order]):
        top = d[y, x]
        ring = d[y - 1 : y + 2, x - 1 : x + 2].sum() - top
        if top > 0 and ring < 0.32 * top:
            continue
        r = 4
        while True:  # area over half the maximum, in a window that holds it
            y0, y1, x0, x1 = max(0, y - r), min(a.shape[0], y + r + 1), max(0, x - r), min(a.shape[1], x + r + 1)
            w = d[y0:y1, x0:x1]
            area = float((w >= w[y - y0, x - x0] / 2).sum())
            if 4 * area < w.size or r >= 64:
                break
            r *= 2
        fwhm = max(1.0, 2 * math.sqrt(area / math.pi))
        cx, cy, sigma = float(x), float(y), max(1.0, fwhm / 2.3548)
        gy, gx = np.mgrid[y0:y1, x0:x1]
        for _ in range(8):
            g = np.exp(-0.5 * ((gx - cx) ** 2 + (gy - cy) ** 2) / sigma**2) * np.maximum(w, 0)
            total = g.sum()
            if total <= 0:
                break
            nx, ny = cx + 2 * ((g * gx).sum() / total - cx), cy + 2 * ((g * gy).sum() / total - cy)
            done = abs(nx - cx) + abs(ny - cy) < 1e-3
            cx, cy = nx, ny
            if done or not (x0 <= cx < x1 and y0 <= cy < y1):
                break
        if abs(cx - x) > 3 or abs(cy - y) > 3:
            cx, cy = float(x), float(y)
        inside = (gx - cx) ** 2 + (gy - cy) ** 2 <= max(2.0, 1.5 * fwhm) ** 2
        flux = float(w[inside].sum())
        if flux <= 0:
            continue
        out.append((cx, cy, flux, fwhm, min(1.0, 1.13 * float(w.max()) * fwhm**2 / flux), flux / (noise[y, x] * math.sqrt(inside.sum())), float(a[y0:y1, x0:x1].max() >= bright)))
    if not out:
        return none
    stars = np.array(out)
    rank = stars[:, 4] * stars[:, 2] / stars[:, 3] ** 2 if by_peak else stars[:, 2]
    stars = stars[np.argsort(-rank, kind="stable")]
    kept: list[int] = []
    for i, row in enumerate(stars):
        near = np.array(kept, int)
        if not len(near) or (np.hypot(stars[near, 0] - row[0], stars[near, 1] - row[1]) > min(max(row[3], 3), 32)).all():
            kept.append(i)
        if len(kept) == most:
            break
    return stars[kept]


def fit_camera(sky: np.ndarray, pixels: np.ndarray, center: tuple[float, float], focal: float, most: float = 0.2) -> tuple[float, np.ndarray, bool, float] | None:
    """Camera of stars seen through a wide lens: focal length in pixels, rotation from camera to sky,
    whether the image is mirrored, and the root mean square error of directions.

    The focal length makes the angles between the stars those of the sky (Newton steps on their
    cosines); the rotation is the orthogonal one closest to it, for either handedness.  None if
    the focal length leaves ``focal`` by more than the share ``most``.
    """
    d = pixels - np.asarray(center)
    i, j = np.triu_indices(len(d), 1)
    want, dots, squares = (sky[i] * sky[j]).sum(axis=1), (d[i] * d[j]).sum(axis=1), (d**2).sum(axis=1)
    f = focal
    for _ in range(4):
        lengths = (squares[i] + f * f) * (squares[j] + f * f)
        cosine = (dots + f * f) / np.sqrt(lengths)
        slope = f * (2 / np.sqrt(lengths) - cosine * (squares[i] + squares[j] + 2 * f * f) / lengths)
        if not (slope**2).sum() > 0:
            return None
        f -= (slope * (cosine - want)).sum() / (slope**2).sum()
        if not f > 0:
            return None
    if abs(f / focal - 1) > most:
        return None
    best = None
    for mirrored in (False, True):
        v = np.column_stack([d[:, 0], -d[:, 1] if mirrored else d[:, 1], np.full(len(d), f)])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        u, _, wt = np.linalg.svd(sky.T @ v)
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ wt))]) @ wt
        error = float(np.sqrt(((v @ r.T - sky) ** 2).sum(axis=1).mean()))
        if best is None or error < best[3]:
            best = (float(f), r, mirrored, error)
    return best

"""Geometry on native columns: boxes, rings, lines and a UTM projection.

A ring is ``array<struct<x,y>>`` without the closing point, a box is four columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def grid_index(v: str | Column, size: float, origin: float = 0.0) -> Column:
    return F.floor((col(v) - origin) / size)


def ring_next(ring: Column) -> Column:
    """The ring rotated by one, so that zipping both gives the edges."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def in_ring(x: str | Column, y: str | Column, ring: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of edges."""
    px, py = col(x), col(y)
    edges = F.zip_with(ring, ring_next(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > py) != (b["y"] > py)
        at = a["x"] + (py - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.coalesce(spans & (px < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(a: Column, b: Column, cx, cy, dx, dy) -> Column:
    """Two segments properly cross each other."""
    return (
        _side(a["x"], a["y"], b["x"], b["y"], cx, cy) * _side(a["x"], a["y"], b["x"], b["y"], dx, dy) < 0
    ) & (_side(cx, cy, dx, dy, a["x"], a["y"]) * _side(cx, cy, dx, dy, b["x"], b["y"]) < 0)


def ring_meets_box(ring: Column, x0, y0, x1, y1) -> Column:
    """A ring and a box share a point: vertex in box, corner in ring, or edges cross."""
    x0, y0, x1, y1 = col(x0), col(y0), col(x1), col(y1)
    vertex = F.exists(ring, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))
    corner = in_ring(x0, y0, ring) | in_ring(x0, y1, ring) | in_ring(x1, y0, ring) | in_ring(x1, y1, ring)
    edges = F.zip_with(ring, ring_next(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sides = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]

    def hits(e: Column) -> Column:
        out = F.lit(False)
        for s in sides:
            out = out | segments_cross(e["a"], e["b"], *s)
        return out

    return vertex | corner | F.exists(edges, hits)


def box_overlap_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    w = F.least(col(ax1), col(bx1)) - F.greatest(col(ax0), col(bx0))
    h = F.least(col(ay1), col(by1)) - F.greatest(col(ay0), col(by0))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def cell_box(x: str | Column, y: str | Column, half: float) -> dict[str, Column]:
    """Square cell around a centre point."""
    x, y = col(x), col(y)
    return {"x0": x - half, "y0": y - half, "x1": x + half, "y1": y + half}


def sample_fractions(n: str | Column) -> Column:
    """Positions of n regular samples along a unit line: the middles of n equal parts."""
    n = col(n)
    return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: (i - 0.5) / n)


def to_utm(lon: str | Column, lat: str | Column, zone: int = 10) -> dict[str, Column]:
    """Easting and northing in metres on WGS84, by the Krueger series to third order."""
    # WGS84 ellipsoid and UTM scale.
    a, f, k0, false_east = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (
        n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16,
        13 * n ** 2 / 48 - 3 * n ** 3 / 5,
        61 * n ** 3 / 240,
    )
    lon0 = math.radians(zone * 6 - 183)
    ecc = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(col(lat)), F.radians(col(lon)) - lon0
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ecc * F.atanh(ecc * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, aj in enumerate(alpha, start=1):
        east = east + aj * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + aj * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return {"easting": false_east + k0 * big_a * east, "northing": k0 * big_a * north}

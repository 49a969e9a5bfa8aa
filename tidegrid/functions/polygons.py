"""Polygons with holes and several parts on native columns.

A ring set is ``array<array<struct<x,y>>>`` without closing points. Outlines run counter-clockwise and holes clockwise, so that
signed areas add up; inside is what an odd number of edges of all rings separates from the far right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import ring_next, segments_cross
from .nulls import col

RINGS = "array<array<struct<x:double,y:double>>>"
_RING = "array<struct<x:double,y:double>>"


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def signed_area(ring: Column) -> Column:
    """Area of a ring, negative if it runs clockwise; taken about its first corner, which keeps digits far from the origin."""
    def about(r: Column, o: Column) -> Column:
        terms = F.zip_with(r, ring_next(r), lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))
        return F.when(F.size(r) < 3, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2)

    return bound(ring, lambda r: bound(F.get(r, F.lit(0)), lambda o: about(r, o)))


def rings_area(rings: str | Column) -> Column:
    return F.aggregate(F.transform(col(rings), signed_area), F.lit(0.0), lambda s, a: s + a)


def oriented(parts: Column) -> Column:
    """Ring set of an array of parts: each part's first ring is its outline, the others are holes."""
    turn = lambda ring, i: F.when((signed_area(ring) < 0) == (i == 0), F.reverse(ring)).otherwise(ring)
    return bound(parts, lambda ps: F.flatten(F.transform(ps, lambda rings: F.transform(rings, turn))))


def rings_edges(rings: str | Column) -> Column:
    """All edges of a ring set as ``array<struct<a,b>>``."""
    pairs = lambda ring: F.zip_with(ring, ring_next(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(col(rings), pairs))


def inside_edges(x: str | Column, y: str | Column, edges: str | Column) -> Column:
    """Even-odd rule over edges of any number of rings: a ray to the right crosses an odd number."""
    px, py = col(x), col(y)

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (py - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.coalesce(((a["y"] > py) != (b["y"] > py)) & (px < at), F.lit(False))

    return F.size(F.filter(col(edges), crosses)) % 2 == 1


def in_rings(x: str | Column, y: str | Column, rings: str | Column) -> Column:
    return inside_edges(x, y, rings_edges(rings))


def rings_meet_box(rings: str | Column, x0, y0, x1, y1) -> Column:
    """A ring set and a box share a point: a corner of a ring in the box, a corner of the box inside, or crossing edges.

    A box that lies in a hole shares none.
    """
    x0, y0, x1, y1 = col(x0), col(y0), col(x1), col(y1)
    sides = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]

    def hits(e: Column) -> Column:
        out = F.lit(False)
        for s in sides:
            out = out | segments_cross(e["a"], e["b"], *s)
        return out

    def meet(edges: Column) -> Column:
        vertex = F.exists(edges, lambda e: e["a"]["x"].between(x0, x1) & e["a"]["y"].between(y0, y1))
        corner = inside_edges(x0, y0, edges) | inside_edges(x0, y1, edges) | inside_edges(x1, y0, edges) | inside_edges(x1, y1, edges)
        return vertex | corner | F.exists(edges, hits)

    return bound(rings_edges(rings), meet)


def clip_ring(ring: Column, convex: Column) -> Column:
    """The part of a ring inside a convex counter-clockwise ring, cut by one half-plane after the other.

    Where the part falls apart, the pieces stay linked along the cut by edges that cancel in the area.
    """
    sides = F.zip_with(convex, ring_next(convex), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cut(subject: Column, side: Column) -> Column:
        a, b = side["a"], side["b"]
        height = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
        ends = F.transform(subject, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), height(p).alias("h")))

        def keep(p: Column, q: Column) -> Column:
            t = p["h"] / (p["h"] - q["h"])
            at = lambda c: p[c] + t * (q[c] - p[c])
            meet = F.struct(at("x").alias("x"), at("y").alias("y"))
            end = F.struct(q["x"].alias("x"), q["y"].alias("y"))
            inside, next_inside = p["h"] >= 0, q["h"] >= 0
            return (
                F.when(inside & next_inside, F.array(end))
                .when(inside, F.array(meet))
                .when(next_inside, F.array(meet, end))
                .otherwise(F.array())
                .cast(_RING)
            )

        return bound(ends, lambda h: F.flatten(F.zip_with(h, ring_next(h), keep))).cast(_RING)

    return F.aggregate(sides, ring.cast(_RING), cut)


def clipped_area(rings: str | Column, convex: Column) -> Column:
    """Area that a ring set shares with a convex ring."""
    return F.aggregate(F.transform(col(rings), lambda r: signed_area(clip_ring(r, convex))), F.lit(0.0), lambda s, a: s + a)


def fan(rings: str | Column) -> Column:
    """A ring set as signed triangles: ``array<struct<sign, ring>>``, every ring fanned out from its first corner.

    Triangles that reach over the outline or over holes cancel, whatever the shape.
    """
    def of_ring(ring: Column) -> Column:
        def triangle(a: Column, b: Column) -> Column:
            corners = F.array(F.get(ring, F.lit(0)), a, b)
            signed = lambda t, s: F.struct(s.alias("sign"), F.when(s < 0, F.reverse(t)).otherwise(t).alias("ring"))
            return bound(corners, lambda t: bound(F.signum(signed_area(t)), lambda s: signed(t, s)))

        return F.filter(F.zip_with(F.slice(ring, 2, F.size(ring) - 2), F.slice(ring, 3, F.size(ring) - 2), triangle), lambda t: t["sign"] != 0)

    return F.flatten(F.transform(F.filter(col(rings), lambda r: F.size(r) > 2), of_ring))


def shared_area(rings: str | Column, triangles: Column) -> Column:
    """Area that a ring set shares with another one given as signed triangles (:func:`fan`)."""
    return F.aggregate(F.transform(triangles, lambda t: t["sign"] * clipped_area(rings, t["ring"])), F.lit(0.0), lambda s, a: s + a)


def box_ring(x0, y0, x1, y1) -> Column:
    corner = lambda x, y: F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def _ring_of_text(text: Column) -> Column:
    """Corners of ``x y, x y, ...``; null if a number is missing or wrong, the ring is open, or has less than three corners."""
    body = F.regexp_replace(F.regexp_replace(text, r"^.*\(", ""), r"\).*$", "")
    pair = lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " ")
    number = lambda p, i: F.get(p, F.lit(i)).try_cast("double")
    raw = F.transform(F.split(body, ","), lambda p: pair(p))
    points = F.transform(raw, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    whole = F.forall(raw, lambda p: F.size(p).between(2, 4)) & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return _closed(F.when(whole, points))


def _closed(points: Column) -> Column:
    ok = lambda p: (F.size(p) >= 4) & (F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1))
    return bound(points, lambda p: F.when(ok(p), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))))


def _all_or_none(parts: Column) -> Column:
    good = lambda ps: F.forall(ps, lambda rings: F.forall(rings, lambda r: r.isNotNull()))
    return bound(parts, lambda ps: F.when(good(ps), oriented(ps)))


def rings_from_wkt(c: str | Column) -> Column:
    """Ring set of POLYGON or MULTIPOLYGON text, with holes and parts; null for anything malformed, no rings for EMPTY."""
    text = F.trim(F.regexp_replace(F.upper(col(c)), r"[\r\n\t]", " "))
    bones = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", "R"), r"\s+Z?M?\s*|\s", ""), ",R", "")
    known = (bones == "POLYGON(R)") | (F.regexp_replace(bones, r",\(R\)", "") == "MULTIPOLYGON((R))")
    parts = F.split(text, r"\)\s*\)\s*,\s*\(\s*\(")
    rings = _all_or_none(F.transform(parts, lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), _ring_of_text)))
    return F.when(bones.isin("POLYGONEMPTY", "MULTIPOLYGONEMPTY"), F.array().cast(RINGS)).when(known, rings.cast(RINGS))


def rings_from_geojson(kind: str | Column, coordinates: str | Column) -> Column:
    """Ring set of a GeoJSON geometry given by its type and its coordinates as text; null for anything else or malformed."""
    kind, text = col(kind), col(coordinates)
    many = F.when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>")).when(
        kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))
    )
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    def ring(r: Column) -> Column:
        points = F.transform(r, point)
        return _closed(F.when(F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), points))

    parts = F.transform(many, lambda rings: F.transform(rings, ring))
    return F.when(F.forall(many, lambda rings: rings.isNotNull()), _all_or_none(parts)).cast(RINGS)

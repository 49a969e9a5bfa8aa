"""Spatial operators over the given tables."""

import math

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.geometry import cell_box, to_utm
from ..functions.polygons import box_ring
from ..operators import spatial as sp
from ..session import staged
from .bindings import APART, HOLE, OUTLINE, half_month_sql, rollover_sql
from .core import query


def _sample_points(t):
    e = t.read("events")
    return e.select(
        "event_id", (F.col("user_id") % 20 + 0.37).alias("x"),
        (F.col("event_id") % 20 + (F.col("value") - F.floor("value"))).alias("y"),
    )


_POINTS = "(SELECT event_id, user_id % 20 + 0.37e0 AS x, event_id % 20 + (value - floor(value)) AS y FROM events)"


@query(
    "points_in_polygons", "G1",
    sql=f"""SELECT event_id, port FROM {_POINTS}, zone_edges e GROUP BY event_id, port
        HAVING count_if((e.ay > y) <> (e.by > y) AND x < e.ax + (y - e.ay) * (e.bx - e.ax) / (e.by - e.ay)) % 2 = 1""",
)
def points_in_polygons(t):
    return sp.points_in_polygons(_sample_points(t), t.zones, "x", "y", "ring", 2.0).select("event_id", "port")


@query(
    "polygon_counts_of_points", "G1 D30", doubles="mean_y",
    sql=f"""SELECT port, count(*) AS n, avg(y) AS mean_y FROM (SELECT event_id, port, any_value(y) AS y FROM {_POINTS}, zone_edges e GROUP BY event_id, port
        HAVING count_if((e.ay > y) <> (e.by > y) AND x < e.ax + (y - e.ay) * (e.bx - e.ax) / (e.by - e.ay)) % 2 = 1) GROUP BY 1""",
)
def polygon_counts_of_points(t):
    j = sp.points_in_polygons(_sample_points(t), t.zones, "x", "y", "ring", 2.0)
    return j.groupBy("port").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"))


def _boxes(t):
    x, y = F.col("gx").cast("double"), F.col("gy").cast("double")
    return t.grid.select("cell_id", x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))


def _odd(px, py):
    return (
        f"(SELECT count_if((e.ay > {py}) <> (e.by > {py}) AND {px} < e.ax + ({py} - e.ay) * (e.bx - e.ax) / (e.by - e.ay)) % 2 = 1 "
        "FROM zone_edges e WHERE e.port = z.port)"
    )


_SIDE = "sign(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))"


def _cross(c, d):
    s = lambda a, b, p: _SIDE.format(a[0], a[1], b[0], b[1], p[0], p[1])
    a, b = ("z.ax", "z.ay"), ("z.bx", "z.by")
    return f"({s(a, b, c)} * {s(a, b, d)} < 0 AND {s(c, d, a)} * {s(c, d, b)} < 0)"


_C = [("gx", "gy"), ("(gx + 1)", "gy"), ("(gx + 1)", "(gy + 1)"), ("gx", "(gy + 1)")]


@query(
    "cells_meeting_polygons", "G2 J14",
    sql="SELECT cell_id, bool_or((ax BETWEEN gx AND gx + 1 AND ay BETWEEN gy AND gy + 1) OR "
    + " OR ".join(_odd(x, y) for x, y in _C) + " OR " + " OR ".join(_cross(_C[i], _C[(i + 1) % 4]) for i in range(4))
    + ") AS in_zone FROM grid, zone_edges z GROUP BY 1",
)
def cells_meeting_polygons(t):
    return sp.intersects_flag(_boxes(t), t.zones, "cell_id", "ring", 2.0, "in_zone").select("cell_id", "in_zone")


def _in_triangle(ps, x, y):
    """SQL: a point is on the inner side of all edges of a counter-clockwise triangle about a port."""
    at = lambda p: (f"(px + {p[0]}e0)", f"(py + {p[1]}e0)")
    side = lambda a, b: f"({b[0]} - {a[0]}) * ({y} - {a[1]}) - ({b[1]} - {a[1]}) * ({x} - {a[0]}) > 0"
    ps = [at(p) for p in ps]
    return "(" + " AND ".join(side(a, b) for a, b in zip(ps, ps[1:] + ps[:1])) + ")"


_HOLE_TURNED = HOLE[::-1]


@query(
    "points_in_ring_sets", "G1",
    sql=f"""SELECT event_id, port FROM {_POINTS}, ports WHERE ({_in_triangle(OUTLINE, 'x', 'y')} AND NOT {_in_triangle(_HOLE_TURNED, 'x', 'y')}) OR {_in_triangle(APART, 'x', 'y')}""",
)
def points_in_ring_sets(t):
    """Points in polygons with a hole and a second part."""
    return sp.points_in_polygons(_sample_points(t), t.waters.select("port", "rings"), "x", "y", "rings", 2.0).select("event_id", "port")


def _box_meets(ps):
    """SQL: a cell and a counter-clockwise triangle about a port are not parted by an edge of either."""
    at = [(f"(px + {p[0]}e0)", f"(py + {p[1]}e0)") for p in ps]
    xs, ys = ", ".join(p[0] for p in at), ", ".join(p[1] for p in at)
    outside = lambda a, b: "(" + " AND ".join(f"({b[0]} - {a[0]}) * ({y} - {a[1]}) - ({b[1]} - {a[1]}) * ({x} - {a[0]}) < 0" for x, y in _C) + ")"
    parted = [f"greatest({xs}) < gx", f"least({xs}) > gx + 1", f"greatest({ys}) < gy", f"least({ys}) > gy + 1", *[outside(a, b) for a, b in zip(at, at[1:] + at[:1])]]
    return "NOT (" + " OR ".join(parted) + ")"


@query(
    "cells_meeting_ring_sets", "G2 J14",
    sql=f"""SELECT cell_id, bool_or(({_box_meets(OUTLINE)} AND NOT ({' AND '.join(_in_triangle(_HOLE_TURNED, x, y) for x, y in _C)})) OR {_box_meets(APART)}) AS in_waters
        FROM grid, ports GROUP BY 1""",
)
def cells_meeting_ring_sets(t):
    """Cells that meet a polygon with a hole and a second part; a cell inside the hole does not."""
    return sp.intersects_flag(_boxes(t), t.waters, "cell_id", "rings", 2.0, "in_waters").select("cell_id", "in_waters")


def _shared_with_box(x0, y0, x1, y1):
    """SQL over ``erased_edges``: area shared with a box, by integrating the height of each edge clamped to the box."""
    lo, hi = f"greatest(least(ax, zx), {x0})", f"least(greatest(ax, zx), {x1})"
    slope = "((zy - ay) / (zx - ax))"
    height = lambda x: f"(ay + ({x} - ax) * {slope})"
    under = lambda y: f"CASE WHEN {y} <= {y0} THEN 0 WHEN {y} <= {y1} THEN ({y} - {y0}) * ({y} - {y0}) / 2 ELSE ({y1} - {y0}) * ({y1} - {y0}) / 2 + ({y1} - {y0}) * ({y} - {y1}) END"
    return f"sum(CASE WHEN {lo} < {hi} THEN sign(ax - zx) * ({under(height(hi))} - {under(height(lo))}) / {slope} ELSE 0 END)"


@query(
    "erased_polygon_overlay", "G3", doubles="value covered_area covered_share", digits=6,
    sql=f"""SELECT cell_id, sum(value * a) / sum(a) AS value, sum(a) AS covered_area, sum(a) / max(area) AS covered_share FROM (
        SELECT cell_id, src, value, whole - CASE WHEN cell_id % 3 = 0 THEN land ELSE 0 END AS a, CASE WHEN cell_id % 3 = 0 THEN 0.85e0 ELSE 1e0 END AS area FROM (
        SELECT cell_id, src, any_value(value) AS value, {_shared_with_box('gx', 'gy', '(gx + 1)', '(gy + 1)')} AS whole,
            {_shared_with_box('(gx + 0.3e0)', '(gy + 0.2e0)', '(gx + 0.6e0)', '(gy + 0.7e0)')} AS land
        FROM grid, erased_edges GROUP BY cell_id, src)) WHERE a > 1e-9 GROUP BY 1""",
)
def erased_polygon_overlay(t):
    """Notched source polygons with holes over grid cells of which every third has land cut out."""
    c = t.grid.select("cell_id", F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    land = F.reverse(box_ring(x + 0.3, y + 0.2, x + 0.6, y + 0.7))
    whole = box_ring(x, y, x + 1, y + 1)
    cells = c.select("cell_id", F.when(F.col("cell_id") % 3 == 0, F.array(whole, land)).otherwise(F.array(whole)).alias("rings"))
    return sp.polygon_overlay(t.erased, cells, "src", "cell_id", "value", size=2.0)


@query(
    "areal_weighted_overlay", "G3 G4", doubles="value covered_area", digits=8,
    sql="""SELECT cell_id, day, sum(value * a) / sum(a) AS value, sum(a) AS covered_area FROM (SELECT cell_id, day, value,
        (least(x + 0.45e0, gx + 1) - greatest(x - 0.45e0, gx)) * (least(y + 0.45e0, gy + 1) - greatest(y - 0.45e0, gy)) AS a
        FROM (SELECT sx * 0.9e0 + 0.5e0 AS x, sy * 0.9e0 + 0.5e0 AS y, day, avg(value) AS value FROM ocean GROUP BY ALL) s JOIN grid
        ON x - 0.45e0 < gx + 1 AND x + 0.45e0 > gx AND y - 0.45e0 < gy + 1 AND y + 0.45e0 > gy) GROUP BY 1, 2""",
)
def areal_weighted_overlay(t):
    src = t.ocean.groupBy("sx", "sy", "day").agg(F.avg("value").alias("value")).select(
        (F.col("sx") * 0.9 + 0.5).alias("x"), (F.col("sy") * 0.9 + 0.5).alias("y"), "day", "value"
    )
    cells = src.withColumns(cell_box("x", "y", 0.45)).drop("x", "y")
    return sp.areal_overlay(cells, _boxes(t), "cell_id", "value", ["day"], 1.0)


@query(
    "line_lengths", "G6", doubles="length_m",
    sql="SELECT set_id, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS length_m FROM lines",
)
def line_lengths(t):
    return t.lines.select("set_id", sp.line_length("x1", "y1", "x2", "y2").alias("length_m"))


@query(
    "points_along_lines", "G7 R6", doubles="x y",
    sql="SELECT set_id, x1 + (i - 0.5e0) / pots * (x2 - x1) AS x, y1 + (i - 0.5e0) / pots * (y2 - y1) AS y FROM lines, range(1, 21) r(i) WHERE i <= pots",
)
def points_along_lines(t):
    return sp.sample_along_line(t.lines, "pots", "x1", "y1", "x2", "y2").select("set_id", "x", "y")


# Pieces of lines in cells by clipping each line to each cell under its box: the parameters where it enters and leaves.
PIECES = """SELECT set_id, cx, cy, (least(1, ox, oy) - greatest(0, ex, ey)) * l AS length FROM (
        SELECT set_id, cx, cy, l, CASE WHEN dx > 0 THEN (cx * {size} - x1) / dx WHEN dx < 0 THEN ((cx + 1) * {size} - x1) / dx ELSE 0 END AS ex,
        CASE WHEN dx > 0 THEN ((cx + 1) * {size} - x1) / dx WHEN dx < 0 THEN (cx * {size} - x1) / dx ELSE 1 END AS ox,
        CASE WHEN dy > 0 THEN (cy * {size} - y1) / dy WHEN dy < 0 THEN ((cy + 1) * {size} - y1) / dy ELSE 0 END AS ey,
        CASE WHEN dy > 0 THEN ((cy + 1) * {size} - y1) / dy WHEN dy < 0 THEN (cy * {size} - y1) / dy ELSE 1 END AS oy
        FROM (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS l,
            unnest(range(CAST(floor(least(x1, x2) / {size}) AS BIGINT), CAST(floor(greatest(x1, x2) / {size}) AS BIGINT) + 1)) AS cx FROM {lines}) s,
        LATERAL (SELECT unnest(range(CAST(floor(least(s.y1, s.y2) / {size}) AS BIGINT), CAST(floor(greatest(s.y1, s.y2) / {size}) AS BIGINT) + 1)) AS cy)
    ) WHERE least(1, ox, oy) - greatest(0, ex, ey) > 1e-12"""


def _utm_sql(zone=10):
    f = 1 / 298.257223563
    n = f / (2 - f)
    big_a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    ecc = 2 * math.sqrt(n) / (1 + n)
    east = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(al, 1))
    north = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(al, 1))
    return f"""SELECT cell_id, 500000e0 + {0.9996 * big_a!r} * (eta + {east}) AS easting, {0.9996 * big_a!r} * (xi + {north}) AS northing FROM (
        SELECT cell_id, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM (
        SELECT cell_id, lam, sinh(atanh(sin(phi)) - {ecc!r} * atanh({ecc!r} * sin(phi))) AS tt FROM (
        SELECT cell_id, radians(lat) AS phi, radians(lon) - {math.radians(zone * 6 - 183)!r} AS lam FROM grid)))"""


@query("utm_projection", "G8", doubles="easting northing", digits=3, sql=_utm_sql())
def utm_projection(t):
    return t.grid.select("cell_id", *[c.alias(n) for n, c in to_utm("lon", "lat").items()])


@query(
    "raster_value_at_point", "G9", doubles="depth",
    sql="""SELECT set_id, b.depth * 0.1e0 AS depth FROM lines LEFT JOIN bathymetry b ON ix = CAST(floor(x1 / 500) AS BIGINT) AND iy = CAST(floor(y1 / 500) AS BIGINT)""",
)
def raster_value_at_point(t):
    return sp.raster_extract(t.lines, t.bathymetry, "x1", "y1", 500.0, "depth", 0.1).select("set_id", "depth")


@query(
    "reject_sets_with_bad_point", "G12",
    sql="""WITH pts AS (SELECT set_id, x1 + (i - 0.5e0) / pots * (x2 - x1) AS x FROM lines, range(1, 21) r(i) WHERE i <= pots)
        SELECT set_id, count(*) AS n FROM pts WHERE set_id NOT IN (SELECT set_id FROM pts WHERE x > 1500) GROUP BY 1""",
)
def reject_sets_with_bad_point(t):
    pts = sp.sample_along_line(t.lines, "pots", "x1", "y1", "x2", "y2").select("set_id", "x")
    return sp.reject_sets(pts, "set_id", F.col("x") > 1500).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


def _targets(t):
    return t.grid.select("cell_id", (F.col("gx") + 0.5).alias("x"), (F.col("gy") + 0.5).alias("y"))


def _samples(t):
    s = t.ocean.groupBy("sx", "sy", "day").agg(F.round(F.avg("value"), 8).alias("value"))
    return s.select(
        "day", (F.col("sx") * 20 + F.col("sy")).alias("sample_id"), (F.col("sx") + 0.25).alias("x"), (F.col("sy") + 0.5).alias("y"), "value"
    )


_SAMPLES = "(SELECT day, sx * 20 + sy AS sample_id, sx + 0.25e0 AS x, sy + 0.5e0 AS y, round(avg(value), 8) AS value FROM ocean GROUP BY ALL)"


@query(
    "inverse_distance_grid", "G13", doubles="value",
    sql=f"""SELECT cell_id, day, coalesce(max(value) FILTER (d = 0), sum(value / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)) AS value FROM (
        SELECT cell_id, day, value, sqrt((gx + 0.5e0 - x) ** 2 + (gy + 0.5e0 - y) ** 2) AS d FROM grid, {_SAMPLES}) GROUP BY 1, 2""",
)
def inverse_distance_grid(t):
    from ..operators.joins import with_dimension

    s = _samples(t)
    slices = with_dimension(_targets(t), s.select("day"))
    return sp.idw(slices, s, ["cell_id"], ["day"], "value", 1.0).select("cell_id", "day", "value")


@query(
    "inverse_distance_nearest", "G13", doubles="value", digits=6,
    sql=f"""SELECT cell_id, day, coalesce(max(value) FILTER (d = 0), sum(value / (d * d)) FILTER (d > 0) / sum(1 / (d * d)) FILTER (d > 0)) AS value, count(*) AS n_used FROM (
        SELECT cell_id, day, value, d, row_number() OVER (PARTITION BY cell_id, day ORDER BY d, sample_id) AS rn FROM (
        SELECT cell_id, day, sample_id, value, sqrt((gx + 0.5e0 - x) * (gx + 0.5e0 - x) + (gy + 0.5e0 - y) * (gy + 0.5e0 - y)) AS d FROM grid, {_SAMPLES}) WHERE d <= 1.9) WHERE rn <= 8 GROUP BY 1, 2""",
)
def inverse_distance_nearest(t):
    """Weights of the eight nearest samples within a distance."""
    from ..operators.joins import with_dimension

    s = _samples(t)
    return sp.idw_nearest(with_dimension(_targets(t), s.select("day")), s, ["cell_id"], "sample_id", "value", 8, ["day"], 2.0, 1.9)


@query(
    "mean_of_four_nearest", "G14", doubles="value", digits=11,
    sql=f"""SELECT cell_id, day, avg(value) AS value, count(*) AS n_used FROM (SELECT cell_id, day, value, row_number() OVER (PARTITION BY cell_id, day ORDER BY d, sample_id) AS rn FROM (
        SELECT cell_id, day, sample_id, value, sqrt((gx + 0.5e0 - x) * (gx + 0.5e0 - x) + (gy + 0.5e0 - y) * (gy + 0.5e0 - y)) AS d FROM grid, {_SAMPLES})) WHERE rn <= 4 GROUP BY 1, 2""",
)
def mean_of_four_nearest(t):
    from ..operators.joins import with_dimension

    s = _samples(t)
    return sp.knn_mean(with_dimension(_targets(t), s.select("day")), s, ["cell_id"], "sample_id", "value", 4, ["day"])


_SLICES = f"""(SELECT {rollover_sql('date', 12, '-')} AS season, {half_month_sql('date')} AS half_month, cell_id, gx, gy, sum(pings) >= 2 AS is_open
    FROM effort JOIN (SELECT cell_id, gx, gy FROM grid) USING (cell_id) GROUP BY ALL)"""


@query(
    "distance_to_closed_cells", "G15", doubles="dist_km",
    sql=f"""SELECT season, half_month, cell_id, arg_min(cid, (d, cid)) AS closed_id, min(d) / 1000 AS dist_km FROM (
        SELECT o.season, o.half_month, o.cell_id, c.cell_id AS cid, sqrt(((o.gx - c.gx) * 5000e0) ** 2 + ((o.gy - c.gy) * 5000e0) ** 2) AS d
        FROM {_SLICES} o JOIN {_SLICES} c ON o.season = c.season AND o.half_month = c.half_month WHERE o.is_open AND NOT c.is_open) GROUP BY 1, 2, 3""",
)
def distance_to_closed_cells(t):
    e = t.effort.groupBy(cal.season("date").alias("season"), cal.half_month("date").alias("half_month"), "cell_id").agg(F.sum("pings").alias("p"))
    s = e.join(t.grid.select("cell_id", (F.col("gx") * 5000.0).alias("x"), (F.col("gy") * 5000.0).alias("y")), "cell_id")
    s = staged(s)
    keys = ["season", "half_month"]
    cols = [*keys, "cell_id", "x", "y"]
    return sp.distance_to_nearest(s.where("p >= 2").select(*cols), s.where("p < 2").select(*cols), "cell_id", keys).select(
        *keys, "cell_id", "closed_id", "dist_km"
    )


@query(
    "cell_centroids", "G16", doubles="cx cy",
    sql="SELECT cell_id, gx + 0.5 AS cx, gy + 0.5 AS cy FROM grid",
)
def cell_centroids(t):
    return _boxes(t).select("cell_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


@query(
    "effort_density", "G17", doubles="density",
    sql="SELECT cell_id, crab_year, sum(lbs) / max(area) AS density FROM effort GROUP BY 1, 2",
)
def effort_density(t):
    return t.effort.groupBy("cell_id", "crab_year").agg((F.sum("lbs") / F.max("area")).alias("density"))


@query(
    "season_footprints", "G18", doubles="footprint_area",
    sql="SELECT crab_year, sum(area) AS footprint_area, count(*) AS n_cell_id FROM (SELECT DISTINCT crab_year, cell_id, area FROM effort WHERE pings > 0) GROUP BY 1",
)
def season_footprints(t):
    return sp.footprint_area(t.effort.where("pings > 0"), ["crab_year"], "cell_id", "area")


@query(
    "footprint_season_overlap", "G18",
    sql="SELECT n_seasons, count(*) AS n_cells FROM (SELECT cell_id, count(DISTINCT crab_year) AS n_seasons FROM effort WHERE pings > 0 GROUP BY 1) GROUP BY 1",
)
def footprint_season_overlap(t):
    return sp.season_overlap(t.effort.where("pings > 0"), "cell_id", "crab_year").groupBy("n_seasons").agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    "clip_to_cell_set", "G19", doubles="lbs",
    sql="SELECT vessel_id, sum(lbs) AS lbs, count(*) AS n FROM pings WHERE cell_id IN (SELECT cell_id FROM grid WHERE region = 'NorCA') GROUP BY 1",
)
def clip_to_cell_set(t):
    return sp.ever_active(t.pings, t.grid.where("region = 'NorCA'"), "cell_id").groupBy("vessel_id").agg(
        F.sum("lbs").alias("lbs"), F.count(F.lit(1)).alias("n")
    )


@query(
    "line_length_per_cell", "G20 J13", doubles="length_m", digits=4,
    sql=f"""SELECT cx, cy, count(*) AS n, sum(length) AS length_m FROM ({PIECES.format(size="500e0", lines="lines")}) GROUP BY 1, 2""",
)
def line_length_per_cell(t):
    """Lines cut at every cell border: how many run through a cell, and their length inside it."""
    c = sp.cut_lines(t.lines, "x1", "y1", "x2", "y2", 500.0)
    return c.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length_m"))


@query(
    "first_cell_of_lines", "J13",
    sql="SELECT CAST(floor(x1 / 500) AS BIGINT) AS cx, CAST(floor(y1 / 500) AS BIGINT) AS cy, count(*) AS n FROM lines GROUP BY 1, 2",
)
def first_cell_of_lines(t):
    """Point in cell: where lines begin."""
    return sp.assign_cell(t.lines, "x1", "y1", 500.0).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nearest_overlay_totals", "G5", doubles="base_total overlay_total", digits=6,
    sql="""WITH b AS (SELECT port, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y, 1 + port % 7 AS dens FROM ports),
        n AS (SELECT cell_id, area, arg_min(dens, (sqrt((gx - x) ** 2 + (gy - y) ** 2), port)) AS dens, arg_min(port, (sqrt((gx - x) ** 2 + (gy - y) ** 2), port)) AS port FROM grid, b GROUP BY 1, 2)
        SELECT port, count(*) AS n_cells, any_value(dens) * 25e0 AS base_total, sum(dens * area) AS overlay_total FROM n GROUP BY 1""",
)
def nearest_overlay_totals(t):
    """Cells take the density of the nearest base point; abundance per base point before and after."""
    cells = t.grid.select("cell_id", "area", F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"))
    base = t.ports.select("port", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), (1 + F.col("port") % 7).alias("dens"))
    over = sp.nearest_overlay(cells, base, "cell_id", "port", "dens")
    return sp.overlay_totals(over, base.withColumn("area", F.lit(25.0)), "port", "dens", "area")


@query(
    "cell_depth_statistics", "G21", doubles="mean sd min max median", digits=6,
    sql="""SELECT cell_id, count(*) AS n, avg(depth) AS mean, stddev_samp(depth) AS sd, min(depth) AS min, max(depth) AS max, median(depth) AS median
        FROM (SELECT floor(ix / 4) * 100 + floor(iy / 4) AS cell_id, depth FROM bathymetry WHERE depth > -5000) GROUP BY 1""",
)
def cell_depth_statistics(t):
    b = t.bathymetry.where("depth > -5000").withColumn("cell_id", (F.floor(F.col("ix") / 4) * 100 + F.floor(F.col("iy") / 4)).cast("double"))
    return sp.cell_depth_stats(b, "cell_id", "depth")

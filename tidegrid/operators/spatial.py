"""Spatial joins as bucketed equi-joins with an exact residual test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType

from ..functions.geometry import (
    box_overlap_area,
    distance,
    grid_index,
    sample_fractions,
)
from ..functions.polygons import clipped_area, fan, inside_edges, rings_area, rings_edges, rings_meet_box, shared_area
from .aggs import sum_distinct_by
from .neighbours import k_nearest

def _bucket_range(lo: str, hi: str, size: float) -> Column:
    return F.sequence(grid_index(lo, size), grid_index(hi, size))


def ring_box(df: DataFrame, ring: str) -> DataFrame:
    """Bounding box columns of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return df.withColumns(
        {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
    )


def _as_rings(df: DataFrame, ring: str) -> Column:
    """A column of rings or of ring sets, as ring sets."""
    inner = df.schema[ring].dataType.elementType
    return F.col(ring) if isinstance(inner, ArrayType) else F.when(F.col(ring).isNotNull(), F.array(ring))


def _touched_buckets(rings: Column, size: float) -> Column:
    """Buckets under the box of any ring, each once. A part far from the others costs none in between."""
    def of_ring(r: Column) -> Column:
        span = lambda c: F.sequence(
            grid_index(F.array_min(F.transform(r, lambda p: p[c])), size), grid_index(F.array_max(F.transform(r, lambda p: p[c])), size)
        )
        return F.flatten(F.transform(span("x"), lambda i: F.transform(span("y"), lambda j: F.struct(i.alias("i"), j.alias("j")))))

    return F.array_distinct(F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 2), of_ring)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, size: float) -> DataFrame:
    """Point-polygon pairs where the point lies inside; ``ring`` holds rings, or ring sets with holes and parts.

    A polygon goes to each bucket that one of its rings' boxes touches, with just the edges that a ray to the right of a point
    in the bucket may meet; a point has exactly one bucket. The outline itself is not in the result. Polygons without an outline hold nothing.
    Nothing after the join needs its partitioning, so adaptive execution deals a crowded bucket
    over as many tasks as it has data for.
    """
    p = points.withColumns({"_bx": grid_index(x, size), "_by": grid_index(y, size)})
    rings = _as_rings(polygons, ring)
    g = polygons.withColumns({"_edges": rings_edges(rings), "_b": F.explode(_touched_buckets(rings, size))})
    low, high, left = ((F.col(f"_b.{c}") + d) * size for c, d in (("j", -1e-6), ("j", 1 + 1e-6), ("i", -1e-6)))
    meets = lambda e: (F.greatest(e["a"]["y"], e["b"]["y"]) >= low) & (F.least(e["a"]["y"], e["b"]["y"]) <= high) & (F.greatest(e["a"]["x"], e["b"]["x"]) >= left)
    g = g.withColumn("_edges", F.filter("_edges", meets)).select(*[c for c in polygons.columns if c != ring], "_edges", F.col("_b.i").alias("_bx"), F.col("_b.j").alias("_by"))
    return p.join(g, ["_bx", "_by"]).where(inside_edges(x, y, "_edges")).drop("_bx", "_by", "_edges")


def assign_cell(points: DataFrame, x: str, y: str, size: float, origin=(0.0, 0.0)) -> DataFrame:
    """Column and row of the regular grid cell that holds a point; no join needed."""
    return points.withColumns(
        {"cx": grid_index(x, size, origin[0]), "cy": grid_index(y, size, origin[1])}
    )


def box_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that overlap. Both sides have x0, y0, x1, y1; the right's get suffix ``_r``.

    A pair that shares several buckets is kept only in the bucket of the
    overlap's lower left corner, so no distinct is needed.
    """
    def spread(df, a, b, c, d):
        return df.withColumn("_bx", F.explode(_bucket_range(a, c, size))).withColumn(
            "_by", F.explode(_bucket_range(b, d, size))
        )

    r = right.withColumnsRenamed({c: f"{c}_r" for c in ("x0", "y0", "x1", "y1")})
    pairs = spread(left, "x0", "y0", "x1", "y1").join(
        spread(r, "x0_r", "y0_r", "x1_r", "y1_r"), ["_bx", "_by"]
    )
    home = (F.floor(F.greatest("x0", "x0_r") / size) == F.col("_bx")) & (
        F.floor(F.greatest("y0", "y0_r") / size) == F.col("_by")
    )
    meets = (
        (F.col("x0") <= F.col("x1_r")) & (F.col("x0_r") <= F.col("x1"))
        & (F.col("y0") <= F.col("y1_r")) & (F.col("y0_r") <= F.col("y1"))
    )
    return pairs.where(home & meets).drop("_bx", "_by")


def intersects_flag(cells: DataFrame, zones: DataFrame, cell_id: str, ring: str, size: float, out: str) -> DataFrame:
    """Flag cells that meet at least one polygon; ``ring`` holds rings, or ring sets with holes and parts.

    Cells meet the box of each ring; a cell inside a hole meets no polygon.
    """
    parts = zones.select(_as_rings(zones, ring).alias("_rings")).withColumn("_ring", F.explode("_rings"))
    hits = (
        box_pairs(cells.select(cell_id, "x0", "y0", "x1", "y1"), ring_box(parts, "_ring").drop("_ring"), size)
        .where(rings_meet_box("_rings", "x0", "y0", "x1", "y1"))
        .select(cell_id)
        .distinct()
        .withColumn(out, F.lit(True))
    )
    return cells.join(hits, cell_id, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def areal_overlay(src: DataFrame, tgt: DataFrame, tgt_id: str, value: str, extra_keys=(), size: float = 1.0) -> DataFrame:
    """Area-weighted mean of source cell values over each target cell.

    Values come long (one row per source cell and date in ``extra_keys``). Overlaps are worked out once per
    distinct source cell and then met by the values, so many dates on one place cost no geometry.
    """
    box = ["x0", "y0", "x1", "y1"]
    weights = (
        box_pairs(src.select(*box).distinct(), tgt, size)
        .withColumn("_a", box_overlap_area(*box, "x0_r", "y0_r", "x1_r", "y1_r"))
        .where("_a > 0")
        .select(*box, tgt_id, "_a")
    )
    used = src.where(F.col(value).isNotNull()).join(weights, box)
    return used.groupBy(tgt_id, *extra_keys).agg(
        (F.sum(F.col(value) * F.col("_a")) / F.sum("_a")).alias(value), F.sum("_a").alias("covered_area")
    )


def polygon_overlay(src: DataFrame, tgt: DataFrame, src_id: str, tgt_id: str, value: str, extra_keys=(), size: float = 1.0,
                    convex: bool = False, least_share: float = 1e-9) -> DataFrame:
    """Area-weighted mean of source polygon values over each target polygon, the covered area and its share of the target.

    Both sides have ``rings``: any shapes, with holes and parts (land cut out). Values come long (one row per source polygon and
    slice in ``extra_keys``); areas are worked out once per pair of shapes and then met by the values. A target is taken apart into signed
    triangles and the source clipped by each; ``convex`` says that targets are single convex rings, to be clipped by at once.
    Overlaps below ``least_share`` of the target are rounding, not area. Targets that nothing covers, and shapes without an outline,
    have no row; null values cover nothing.
    """
    def boxed(df: DataFrame, key: str, suffix: str) -> DataFrame:
        shapes = df.where(F.size("rings") > 0).select(key, "rings").dropDuplicates([key])
        return ring_box(shapes.withColumn("_all", F.flatten("rings")), "_all").drop("_all").withColumnRenamed("rings", f"_rings{suffix}")

    targets = boxed(tgt, tgt_id, "_t").withColumns({"_area": rings_area("_rings_t"), "_cut": F.col("_rings_t") if convex else fan("_rings_t")}).drop("_rings_t")
    pairs = box_pairs(boxed(src, src_id, "_s"), targets, size)
    shared = clipped_area("_rings_s", F.col("_cut")[0]) if convex else shared_area("_rings_s", F.col("_cut"))
    # Clipping is the work here, so pairs are dealt evenly before it.
    weights = pairs.repartition(src_id, tgt_id).withColumn("_a", shared).where(F.col("_a") > least_share * F.col("_area")).select(src_id, tgt_id, "_a", "_area")
    used = src.where(F.col(value).isNotNull()).select(src_id, *extra_keys, value).join(weights, src_id)
    return used.groupBy(tgt_id, *extra_keys).agg(
        (F.sum(F.col(value) * F.col("_a")) / F.sum("_a")).alias(value), F.sum("_a").alias("covered_area"), (F.sum("_a") / F.max("_area")).alias("covered_share")
    )


def cut_lines(lines: DataFrame, x1: str, y1: str, x2: str, y2: str, size: float, origin=(0.0, 0.0)) -> DataFrame:
    """One row per line and grid cell it runs through: column ``cx`` and row ``cy`` of the cell, ``length`` inside it.

    The line is cut where it passes grid lines, so lengths add up to the line's. A piece along a grid line belongs to the cell
    above or to the right. A line without length is one piece of length 0; one with a missing end has none.
    """
    def passed(a: str, b: str, start: float) -> Column:
        lo, hi = F.least(a, b) - start, F.greatest(a, b) - start
        first, last = F.floor(lo / size) + 1, F.ceil(hi / size) - 1
        ks = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(ks, lambda k: (k * size + start - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0)))

    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), passed(x1, x2, origin[0]), passed(y1, y2, origin[1]))))
    n = F.size("_at") - 1
    pieces = F.zip_with(F.slice("_at", F.lit(1), n), F.slice("_at", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    real = lambda p: (p["b"] - p["a"] > 1e-12) | (F.size("_at") == 2)  # two cuts at a corner leave a speck between them
    mid = (F.col("_p.a") + F.col("_p.b")) / 2
    cell = lambda a, b, start: F.floor((F.col(a) + mid * (F.col(b) - F.col(a)) - start) / size)
    whole = lines.where(F.col(x1).isNotNull() & F.col(y1).isNotNull() & F.col(x2).isNotNull() & F.col(y2).isNotNull())
    cut = whole.withColumn("_at", at).withColumn("_p", F.explode(F.filter(pieces, real)))
    return cut.withColumns({
        "cx": cell(x1, x2, origin[0]), "cy": cell(y1, y2, origin[1]), "length": (F.col("_p.b") - F.col("_p.a")) * distance(x1, y1, x2, y2)
    }).drop("_at", "_p")


def line_length(x1, y1, x2, y2) -> Column:
    return distance(x1, y1, x2, y2)


def sample_along_line(df: DataFrame, n: str, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """One row per regular sample point of a line, columns ``x`` and ``y``."""
    f = F.col("_f")
    return (
        df.withColumn("_f", F.explode(sample_fractions(n)))
        .withColumns(
            {
                "x": F.col(x1) + f * (F.col(x2) - F.col(x1)),
                "y": F.col(y1) + f * (F.col(y2) - F.col(y1)),
            }
        )
        .drop("_f")
    )


def raster_extract(points: DataFrame, cells: DataFrame, x: str, y: str, size: float, value: str, scale: float = 1.0) -> DataFrame:
    """Value of the raster cell (ix, iy) under each point, times a unit scale."""
    p = points.withColumns({"ix": grid_index(x, size), "iy": grid_index(y, size)})
    v = cells.select("ix", "iy", (F.col(value) * scale).alias(value))
    return p.join(v, ["ix", "iy"], "left").drop("ix", "iy")


def nearest(left: DataFrame, right: DataFrame, left_id, right_id: str, keys=()) -> DataFrame:
    """Nearest right point per left point; ties go to the smaller id."""
    return k_nearest(left, right, left_id, right_id, 1, keys).select(*dict.fromkeys([*left_id, *keys]), "dist", right_id)


def knn_mean(left: DataFrame, right: DataFrame, left_id, right_id: str, value: str, k: int, keys=()) -> DataFrame:
    near = k_nearest(left, right, left_id, right_id, k, keys, [value])
    return near.groupBy(*left_id, *keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_used"))


def nearest_overlay(cells: DataFrame, base: DataFrame, cell_id: str, base_id: str, value: str) -> DataFrame:
    """Each cell with the value of its nearest base point."""
    near = nearest(cells, base.select(base_id, "x", "y"), [cell_id], base_id)
    return cells.join(near.select(cell_id, base_id), cell_id).join(base.select(base_id, value), base_id)


def overlay_totals(overlay: DataFrame, base: DataFrame, base_id: str, value: str, area: str) -> DataFrame:
    """Total abundance (value times area) of each base point, and of the cells that took its value."""
    cells = overlay.groupBy(base_id).agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.col(value) * F.col(area)).alias("overlay_total"))
    return cells.join(base.select(base_id, (F.col(value) * F.col(area)).alias("base_total")), base_id)


def distance_to_nearest(open_cells: DataFrame, closed_cells: DataFrame, cell_id: str, keys, unit: float = 1000.0) -> DataFrame:
    """Distance from each open cell to the nearest closed cell of the same time slice, in km."""
    closed = closed_cells.select(*keys, F.col(cell_id).alias("closed_id"), "x", "y")
    near = nearest(open_cells, closed, [cell_id], "closed_id", keys)
    return near.withColumn("dist_km", F.col("dist") / unit).drop("dist")


def idw(targets: DataFrame, samples: DataFrame, target_id, keys, value: str, power: float = 1.0, block: int = 2048) -> DataFrame:
    """Inverse-distance interpolation from all samples of the same slice.

    ``samples`` must hold one row per place and slice. The samples of a slice ride in arrays of about
    ``block`` places. Sums of weights and of weighted values add up over blocks, so a
    block is folded in place, no sample-target pair becomes a row, and no array grows with a slice. A target on
    a sample takes its value.
    """
    keys, ids = list(keys), [*target_id, *keys]
    sizes = samples.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("_nb"))
    dealt = samples.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64("x", "y"), F.col("_nb")))
    sets = dealt.groupBy(*keys, "_block").agg(F.collect_list(F.struct("x", "y", F.col(value).cast("double").alias("v"))).alias("_s"))
    # The fold is the work here, not the row count, so the targets are spread over all tasks.
    t = targets.repartition(*ids).join(sets, keys)
    gap = lambda s: (s["x"] - F.col("x")) * (s["x"] - F.col("x")) + (s["y"] - F.col("y")) * (s["y"] - F.col("y"))
    t = t.withColumn("_d", F.transform("_s", lambda s: F.sqrt(gap(s))))
    weight = lambda d: F.pow(F.nullif(d, F.lit(0.0)), F.lit(-float(power))) if power != 1.0 else 1.0 / F.nullif(d, F.lit(0.0))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    exact = F.get("_s", F.array_position("_d", F.lit(0.0)).cast("int") - 1)["v"]
    part = t.withColumns({
        "_hit": F.when(F.array_contains("_d", F.lit(0.0)), exact),
        "_vw": total(F.zip_with("_d", "_s", lambda d, s: weight(d) * s["v"])),
        "_w": total(F.transform("_d", weight)),
    })
    rest = [c for c in targets.columns if c not in ids]
    out = part.groupBy(*ids).agg(*[F.first(c).alias(c) for c in rest], F.max("_hit").alias("_hit"), F.sum("_vw").alias("_vw"), F.sum("_w").alias("_w"))
    return out.withColumn(value, F.coalesce("_hit", F.col("_vw") / F.col("_w"))).drop("_hit", "_vw", "_w")


def idw_nearest(targets: DataFrame, samples: DataFrame, target_id, sample_id: str, value: str, n: int, keys=(), power: float = 1.0,
                farthest: float | None = None) -> DataFrame:
    """Inverse-distance interpolation from the ``n`` nearest samples of the same slice, none farther than ``farthest``.

    A target on a sample takes its value (the mean, if several samples lie there). ``n_used`` tells how many samples counted. Targets without a sample
    in reach have no row; samples without a value don't count.
    """
    ids = list(dict.fromkeys([*target_id, *keys]))
    near = k_nearest(targets, samples.where(F.col(value).isNotNull()), target_id, sample_id, n, keys, [value], farthest)
    weight = F.pow(F.nullif("dist", F.lit(0.0)), F.lit(-float(power)))
    on = F.avg(F.when(F.col("dist") == 0, F.col(value)))
    return near.groupBy(*ids).agg(F.coalesce(on, F.sum(weight * F.col(value)) / F.sum(weight)).alias(value), F.count(F.lit(1)).alias("n_used"))


def footprint_area(df: DataFrame, keys, cell_id: str, area: str) -> DataFrame:
    """Area of the distinct cells per group, the footprint as a cell set."""
    return sum_distinct_by(df, keys, cell_id, area, "footprint_area")


def season_overlap(df: DataFrame, cell_id: str, season: str) -> DataFrame:
    """In how many seasons each cell was active."""
    return df.groupBy(cell_id).agg(F.countDistinct(season).alias("n_seasons"))


def cell_depth_stats(points: DataFrame, cell_id: str, depth: str) -> DataFrame:
    from .aggs import summary_stats

    return summary_stats(points, [cell_id], depth)


def ever_active(df: DataFrame, activity: DataFrame, cell_id: str) -> DataFrame:
    """Rows in cells that were active at least once."""
    return df.join(activity.select(cell_id).distinct(), cell_id, "left_semi")


def reject_sets(points: DataFrame, set_id: str, bad: Column) -> DataFrame:
    """Drop every point of a set that has at least one bad point."""
    return points.join(points.where(bad).select(set_id), set_id, "left_anti")

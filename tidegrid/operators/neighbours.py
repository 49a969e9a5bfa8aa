"""Nearest neighbours by a tree of tight boxes, searched level by level.

Right points are sorted along a space-filling curve inside their slice; 16 consecutive ones make a leaf, 64 consecutive
nodes a node of the next level. Every node knows its tight box and how many points it holds. A left point goes down the tree
as a set of nodes: the k-th smallest of their greatest distances bounds the distance to the k-th neighbour, and nodes whose
least distance lies beyond that bound are left out before their children, and at last their points, are joined.
Each right point is stored once, whatever the distance or the density.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..session import staged

#: Points in a leaf and nodes under a node as powers of two; bits of the row number inside a task's rows.
LEAF, FAN, ROW_BITS = 4, 6, 33


def _curve(x: Column, y: Column) -> Column:
    """Place on a Z-shaped curve of two whole numbers below 2**31."""
    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def _merged_places(right: DataFrame, right_id: str, keys: list[str], k: int, carry: list[str]) -> DataFrame:
    """Of points at one place only the ``k`` smallest ids can be answers."""
    placed = right.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    r = placed.select(*keys, right_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *carry)
    if k == 1:
        first = F.min(F.struct(right_id, *carry)).alias("_first")
        return r.groupBy(*keys, "x", "y").agg(first).select(*keys, "x", "y", "_first.*")
    nth = F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy(right_id))
    return r.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


def _box(inner: str = "") -> list[Column]:
    low, high = (lambda c, e: F.min(f"{inner}{c}").alias(e)), (lambda c, e: F.max(f"{inner}{c}").alias(e))
    if inner:
        return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n")]
    return [low("x", "x0"), low("y", "y0"), high("x", "x1"), high("y", "y1"), F.count(F.lit(1)).alias("n")]


def _leaves(right: DataFrame, right_id: str, keys: list[str], k: int, carry: list[str]) -> tuple[DataFrame, list[int]]:
    """Leaves with their points, and the shifts that make the nodes of the levels from a leaf's number.

    Points that fill no more leaves than a node may have nodes are sorted in one task and need no table of their own.
    """
    r = _merged_places(right, right_id, keys, k, carry)
    ends = r.agg(F.min("x"), F.min("y"), F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))).first()
    few = ends[4] <= 1 << (LEAF + FAN)
    wide = max(ends[2] or 0.0, ends[3] or 0.0) or 1.0
    whole = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(wide) * F.lit(2.0**31 - 1)).cast("long")
    r = r if few else staged(r)
    on_curve = r.withColumn("_z", _curve(whole("x", ends[0]), whole("y", ends[1])))
    sort = [*keys, "_z", right_id]
    row = (on_curve.coalesce(1) if few else on_curve.repartitionByRange(*sort)).sortWithinPartitions(*sort).withColumn("_row", F.monotonically_increasing_id())
    leaf = F.shiftright("_row", LEAF).alias("node")
    points = F.collect_list(F.struct(F.col(right_id).alias("id"), "x", "y", *carry)).alias("points")
    leaves = row.groupBy(*keys, leaf).agg(*_box(), points)
    if few:
        return leaves, [0]
    leaves, bits = staged(leaves), ROW_BITS - LEAF
    top = leaves.agg(F.max(F.col("node").bitwiseAND(F.lit((1 << bits) - 1))), F.max(F.shiftright("node", bits))).first()
    inside = [s for s in range(0, bits, FAN) if s == 0 or (top[0] or 0) >> (s - FAN) > 0]
    return leaves, inside + [bits + s for s in range(0, 31, FAN) if s == 0 or (top[1] or 0) >> (s - FAN) > 0]


_SUMMARY = ["node", "x0", "y0", "x1", "y1", "n"]


def _bounds(nodes: Column) -> Column:
    """Least and greatest distance from the left point to each node's box."""
    def of(c: Column) -> Column:
        far = lambda v, a, b: F.greatest(F.abs(F.col(v) - c[a]), F.abs(F.col(v) - c[b]))
        gap = lambda v, a, b: F.greatest(c[a] - F.col(v), F.lit(0.0), F.col(v) - c[b])
        size = lambda dx, dy: F.sqrt(dx * dx + dy * dy)
        return F.struct(size(far("x", "x0", "x1"), far("y", "y0", "y1")).alias("hi"), size(gap("x", "x0", "x1"), gap("y", "y0", "y1")).alias("lo"),
                        c["n"].alias("n"), c["node"].alias("node"))

    return F.transform(nodes, of)


def _within_reach(found: str, k: int) -> Column:
    """Nodes that may hold one of the ``k`` nearest: those no farther than the first greatest distance that covers ``k`` points."""
    if k == 1:
        bound = F.array_min(F.transform(found, lambda c: c["hi"]))
    else:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("hi"))
        step = lambda s, c: F.struct((s["n"] + c["n"]).alias("n"), F.when((s["n"] < k) & (s["n"] + c["n"] >= k), c["hi"]).otherwise(s["hi"]).alias("hi"))
        bound = F.aggregate(F.sort_array(found), start, step)["hi"]
    return F.filter(found, lambda c: c["lo"] <= F.col("_bound")), bound


def _pruned(df: DataFrame, k: int) -> DataFrame:
    keep, bound = _within_reach("_found", k)
    return df.withColumn("_bound", bound).withColumn("node", F.explode(F.transform(keep, lambda c: c["node"]))).drop("_found", "_bound")


def leaves_within_reach(left: DataFrame, right: DataFrame, left_id, keys, right_id: str, k: int, carry=()) -> DataFrame:
    """Left points with every leaf that may hold one of their ``k`` nearest right points, as ``points`` (id, x, y and ``carry``).

    Both sides have ``x`` and ``y``; ``keys`` must match exactly (time slices). Points without a place have no
    neighbours.
    """
    left_id, keys = list(left_id), list(keys)
    leaves, shifts = _leaves(right, right_id, keys, k, list(carry))
    summary = F.struct(*_SUMMARY)
    levels = [leaves.select(*keys, *_SUMMARY)]  # nodes of each level
    children = []  # children[i]: nodes of level i + 1 with their children of level i
    for low, high in zip(shifts, shifts[1:]):
        parent = F.shiftright("node", high - low).alias("parent")
        held = levels[-1].groupBy(*keys, parent).agg(*_box("n"), F.collect_list(summary).alias("_nodes"))
        children.append(held.select(*keys, F.col("parent").alias("node"), "_nodes"))
        levels.append(held.select(*keys, F.col("parent").alias("node"), *_SUMMARY[1:]))
    # The search begins at the lowest level that has few nodes in every slice.
    first = len(levels) - 1
    for i, nodes in enumerate(levels[:-1]):
        if (nodes.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= 1 << FAN:
            first = i
            break
    roots = levels[first].groupBy(*keys).agg(F.collect_list(summary).alias("_nodes"))
    pts = left.select(*left_id, *[c for c in keys if c not in left_id], F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    pts = pts.join(roots, keys) if keys else pts.crossJoin(F.broadcast(roots))  # without slices there is one row of roots
    front = _pruned(pts.withColumn("_found", _bounds(F.col("_nodes"))).drop("_nodes"), k)
    own = list(dict.fromkeys([*left_id, *keys, "x", "y"]))
    for i in reversed(range(first)):
        below = front.join(children[i], [*keys, "node"]).withColumn("_found", _bounds(F.col("_nodes")))
        # What one parent's children rule out among themselves need not travel.
        keep, bound = _within_reach("_found", k)
        below = below.withColumn("_bound", bound).withColumn("_found", keep)
        front = _pruned(below.groupBy(*own).agg(F.flatten(F.collect_list("_found")).alias("_found")), k)
    return front.join(leaves.select(*keys, "node", "points"), [*keys, "node"]).drop("node")


def k_nearest(left: DataFrame, right: DataFrame, left_id, right_id: str, k: int, keys=(), carry=(), farthest: float | None = None) -> DataFrame:
    """The k nearest right points per left point, ranked; ties go to the smaller id.

    ``carry`` names columns of the right side that come along, ``farthest`` the greatest distance that counts.
    """
    keys = list(keys)
    ids = list(dict.fromkeys([*left_id, *keys]))
    cand = leaves_within_reach(left, right, left_id, keys, right_id, k, carry)

    def answer(p: Column) -> Column:
        more = [p[c].alias(c) for c in carry]
        return F.struct(distance(F.col("x"), F.col("y"), p["x"], p["y"]).alias("dist"), p["id"].alias(right_id), p["x"].alias("x_r"), p["y"].alias("y_r"), *more)

    reach = F.transform("points", answer)
    if farthest is not None:
        reach = F.filter(reach, lambda a: a["dist"] <= farthest)
        cand = cand.where(F.size(reach) > 0)
    if k == 1:
        best = cand.select(*ids, "x", "y", F.array_min(reach).alias("_b")).groupBy(*ids, "x", "y").agg(F.min("_b").alias("_b"))
        return best.select(*ids, "x", "y", "_b.*", F.lit(1).alias("rank"))
    rows = cand.select(*ids, "x", "y", F.explode(F.slice(F.sort_array(reach), 1, k)).alias("_b")).select(*ids, "x", "y", "_b.*")
    w = Window.partitionBy(*ids).orderBy("dist", right_id)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

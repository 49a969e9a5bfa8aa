"""Polygons with holes and parts, clipping, cut lines, neighbours of dense clusters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import polygons as pg
from tidegrid.operators import neighbours as nb
from tidegrid.operators import spatial as sp
from tidegrid.sources import readers as rd

DONUT = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
TWO = "MULTIPOLYGON (((0 0,0 4,4 4,4 0,0 0),(1 1,2 1,2 2,1 1)) , ((10 10, 11 10, 11 11, 10 10)))"


def rings_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, wkt string").withColumn("rings", pg.rings_from_wkt("wkt"))


def test_rings_of_text(spark):
    texts = [DONUT, TWO, "POLYGON EMPTY", "polygon z ((0 0 1, 4 0 1, 4 4 1, 0 0 1))", "POLYGON ((0 0, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 1 x, 0 0))",
             "POLYGON ((0 0, 1 0, 1 1, 0 1))", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 1 0, 1 1, 0 0)", "POLYGON (0 0, 1 0, 1 1, 0 0)", "", None]
    rows = rings_of(spark, texts).select("i", F.size("rings").alias("n"), pg.rings_area("rings").alias("a")).sort("i").collect()
    assert [r.n for r in rows] == [2, 3, 0, 1] + [None] * 8
    assert [r.a for r in rows[:4]] == [15.0, 16.0, 0.0, 8.0]


def test_holes_and_parts_count(spark):
    q = rings_of(spark, [TWO]).select(
        pg.in_rings(F.lit(1.6), F.lit(1.3), "rings"), pg.in_rings(F.lit(10.8), F.lit(10.3), "rings"), pg.in_rings(F.lit(3.0), F.lit(3.0), "rings"),
        pg.rings_meet_box("rings", F.lit(1.6), F.lit(1.1), F.lit(1.9), F.lit(1.4)), pg.rings_meet_box("rings", F.lit(1.5), F.lit(1.2), F.lit(2.5), F.lit(1.4)),
        pg.rings_meet_box("rings", F.lit(5.0), F.lit(5.0), F.lit(9.0), F.lit(9.0)),
    )
    assert tuple(q.first()) == (False, True, True, False, True, False)


def test_polygon_files_keep_every_ring(spark, tmp_path):
    (tmp_path / "p.csv").write_text(f'id,wkt\na,"{DONUT}"\nb,"{TWO}"\nc,"POLYGON ((0 0, 1 1))"\n')
    rows = {r.id: r for r in rd.read_polygons(spark, str(tmp_path / "p.csv")).collect()}
    assert len(rows["a"].rings) == 2 and rows["a"].ring is None and len(rows["b"].rings) == 3 and rows["c"].rings is None
    with pytest.raises(Exception, match="malformed outline"):
        rd.read_polygons(spark, str(tmp_path / "p.csv"), strict=True).collect()
    many = '[[[[0,0],[4,0],[4,4],[0,0]],[[2,1],[3,1],[3,2],[2,1]]],[[[9,9],[10,9],[10,10],[9,9]]]]'
    (tmp_path / "p.json").write_text('{"type":"Feature","properties":{"id":"z"},"geometry":{"type":"MultiPolygon","coordinates":' + many + '}}\n'
                                     '{"type":"Feature","properties":{"id":"y"},"geometry":{"type":"Point","coordinates":[1,2]}}\n')
    rows = {r.properties["id"]: r.rings for r in rd.read_polygons(spark, str(tmp_path / "p.json"), "geojson").collect()}
    assert [len(r) for r in rows["z"]] == [3, 3, 3] and rows["y"] is None


def random_star(rng, x, y):
    """A ring around a place whose corners go round once at random distances, mostly not convex."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))
    return [(x + r * math.cos(a), y + r * math.sin(a)) for a in angles for r in [rng.uniform(0.4, 1.5)]]


def test_shared_area_of_any_shapes(spark):
    """Both ways of cutting, and areas over the cells of a grid that add up to the whole."""
    rng = random.Random(8)
    shapes = [(i, [[{"x": px, "y": py} for px, py in random_star(rng, rng.uniform(2, 6), rng.uniform(2, 6))]]) for i in range(12)]
    df = spark.createDataFrame(shapes, f"i int, rings {pg.RINGS}").withColumn("rings", pg.oriented(F.array("rings"))).withColumn("v", F.lit(2.0))
    cells = spark.range(64).select("id", (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    cells = cells.select("id", F.array(pg.box_ring("x", "y", F.col("x") + 1, F.col("y") + 1)).alias("rings"))
    whole = {r.i: r.a for r in df.select("i", pg.rings_area("rings").alias("a")).collect()}
    for convex in (False, True):
        got = sp.polygon_overlay(df, cells, "i", "id", "v", ["i"], 2.0, convex).groupBy("i").agg(F.sum("covered_area").alias("a"), F.min("v").alias("v")).collect()
        assert {r.i: round(r.a, 9) for r in got} == {i: round(a, 9) for i, a in whole.items()}
        assert all(r.v == 2.0 for r in got)
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.i < b.i")).select(
        pg.shared_area("a.rings", pg.fan("b.rings")).alias("ab"), pg.shared_area("b.rings", pg.fan("a.rings")).alias("ba")).collect()
    assert all(abs(p.ab - p.ba) < 1e-9 and p.ab > -1e-12 for p in pairs)


def test_overlay_on_nothing(spark):
    src = spark.createDataFrame([(1, None, 3.0), (2, [], 1.0), (3, [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]], None)], f"i int, rings {pg.RINGS}, v double")
    tgt = rings_of(spark, [DONUT]).select(F.col("i").alias("t"), "rings")
    assert sp.polygon_overlay(src, tgt, "i", "t", "v").count() == 0
    assert sp.polygon_overlay(src.fillna(4.0), tgt, "i", "t", "v").first().covered_area == pytest.approx(0.5)


def test_cut_lines_add_up(spark):
    rng = random.Random(9)
    rows = [(i, *[rng.uniform(-30, 30) for _ in range(4)]) for i in range(200)]
    rows += [(500, 2.0, 2.0, 2.0, 9.0), (501, 0.0, 0.0, 6.0, 6.0), (502, 1.5, 1.5, 1.5, 1.5), (503, 4.0, 1.0, -4.0, 1.0), (504, None, 1.0, 2.0, 3.0), (505, 2.0, 2.0, 4.0, 2.0)]
    df = spark.createDataFrame(rows, "i int, x1 double, y1 double, x2 double, y2 double")
    cut = sp.cut_lines(df, "x1", "y1", "x2", "y2", 2.0).collect()
    total = {}
    for r in cut:
        total[r.i] = total.get(r.i, 0) + r.length
        ends = [(r.x1, r.x2, r.cx), (r.y1, r.y2, r.cy)]
        assert all(min(a, b) - 1e-9 <= (c + 1) * 2 and c * 2 <= max(a, b) + 1e-9 for a, b, c in ends)
    for i, a, b, c, d in rows:
        if a is not None:
            assert total[i] == pytest.approx(math.dist((a, b), (c, d)))
    assert 504 not in total and len({(r.i, r.cx, r.cy) for r in cut}) == len(cut)
    assert sorted((r.cx, r.cy) for r in cut if r.i == 501) == [(0, 0), (1, 1), (2, 2)]


def test_far_targets_of_a_dense_cluster_meet_few_points(spark):
    """A hundred thousand points in one place, a thousand targets far away, and the same with all points on one spot."""
    right = spark.range(100_000).select(F.col("id").alias("rid"), (F.rand(1) * 3).alias("x"), (F.rand(2) * 3).alias("y"))
    left = spark.range(1000).select(F.col("id").alias("lid"), (F.cos("id") * 1e6).alias("x"), (F.sin("id") * 1e6).alias("y"))
    met = nb.leaves_within_reach(left, right, ["lid"], [], "rid", 1).agg(F.sum(F.size("points")).alias("n"), F.countDistinct("lid").alias("l")).first()
    assert met.l == 1000 and met.n < 1000 * 600
    same = right.withColumns({"x": F.lit(1.0), "y": F.lit(1.0)})
    got = sp.k_nearest(left, same, ["lid"], "rid", 3).groupBy("rid").count().collect()
    assert sorted((r.rid, r["count"]) for r in got) == [(0, 1000), (1, 1000), (2, 1000)]


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_in_a_deep_tree(spark, monkeypatch, k):
    """Several levels, with nodes of four: the same as brute force, slice by slice."""
    monkeypatch.setattr(nb, "FAN", 2)
    monkeypatch.setattr(nb, "LEAF", 1)
    rng = random.Random(10)
    r = [(i, rng.choice("ab"), rng.gauss(0, 1) ** 3, rng.gauss(0, 1)) for i in range(700)]
    l = [(i, rng.choice("abc"), rng.uniform(-9, 9), rng.uniform(-3, 3)) for i in range(60)] + [(99, "a", None, 1.0)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} int, s string, x double, y double")
    got = {}
    for p in sp.k_nearest(df(l, "lid"), df([*r, (9999, "a", None, None)], "rid"), ["lid"], "rid", k, ["s"]).collect():
        got.setdefault(p.lid, {})[p.rank] = p.rid
    want = {}
    for i, s, x, y in l[:-1]:
        near = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, t, a, b in r if t == s)[:k]
        if near:
            want[i] = {n: j for n, (_, j) in enumerate(near, 1)}
    assert got == want


def test_interpolation_from_all_samples_is_the_full_fold(spark):
    rng = random.Random(11)
    s = spark.createDataFrame([(i, "d", rng.uniform(0, 5), rng.uniform(0, 5), rng.random()) for i in range(40)] + [(40, "d", 9.0, 9.0, None)], "sid int, t string, x double, y double, v double")
    c = spark.createDataFrame([(i, "d", rng.uniform(0, 5), rng.uniform(0, 5)) for i in range(30)], "c int, t string, x double, y double")
    full = {r.c: r.v for r in sp.idw(c, s.where("v IS NOT NULL"), ["c"], ["t"], "v", 2.0).collect()}
    near = {r.c: (r.v, r.n_used) for r in sp.idw_nearest(c, s, ["c"], "sid", "v", 40, ["t"], 2.0).collect()}
    assert {k: pytest.approx(v) for k, v in full.items()} == {k: v for k, (v, _) in near.items()} and {n for _, n in near.values()} == {40}
    reach = sp.idw_nearest(c, s, ["c"], "sid", "v", 3, ["t"], 2.0, 0.5).collect()
    assert all(r.n_used <= 3 for r in reach)

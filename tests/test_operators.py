"""Operators against brute force, with hot groups and ties."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import aggs, joins, reshape, skew, spatial, stats, windows


def hot_frame(spark, n=3000, seed=1):
    """One key holds a third of all rows, one value is repeated very often."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        v = 7.5 if rng.random() < 0.3 else round(rng.uniform(0, 100), 2)
        rows.append((i, k, v if rng.random() > 0.02 else None))
    return spark.createDataFrame(rows, "id long, k string, v double"), rows


def quantile7(xs, q):
    xs = sorted(xs)
    pos = (len(xs) - 1) * q
    lo, hi = math.floor(pos), math.ceil(pos)
    return xs[lo] + (xs[hi] - xs[lo]) * (pos - lo)


@pytest.mark.parametrize("buckets", [1, 3, 8, 50])
def test_exact_quantiles(spark, buckets):
    df, rows = hot_frame(spark)
    got = {r.k: (r.a, r.m, r.z) for r in skew.exact_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.975}, buckets).collect()}
    groups = {}
    for _, k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k] == pytest.approx(tuple(quantile7(xs, q) for q in (0.1, 0.5, 0.975)))


def test_quantiles_without_keys(spark):
    df, rows = hot_frame(spark)
    xs = [v for _, _, v in rows if v is not None]
    assert skew.exact_quantiles(df, [], "v", {"m": 0.25}).first().m == pytest.approx(quantile7(xs, 0.25))


def test_running_percent_and_cdf(spark):
    df, rows = hot_frame(spark, 600)
    hot = sorted(v for _, k, v in rows if k == "hot" and v is not None)
    got = windows.running_percent(df, ["k"], "v").where("k = 'hot'").orderBy("v").collect()
    assert [r.running_n for r in got] == [sum(1 for x in hot if x <= v) for v in sorted(set(hot))]
    assert got[-1].running_pct == pytest.approx(100.0)
    cdf = windows.empirical_cdf(df, ["k"], "v").where("k = 'hot'").collect()
    assert len(cdf) == len(hot)
    assert all(r.ecdf == pytest.approx(sum(1 for x in hot if x <= r.v) / len(hot)) for r in cdf)


def test_top_fraction_keeps_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in [9, 9, 9, 1, 2, 3, 4, 5, 6, 7]], "v double")
    assert sorted(r.v for r in windows.top_fraction(df, "v", 0.1).collect()) == [9, 9, 9]


def test_attach_totals_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "k string, v double")
    got = sorted((r.v, r.s) for r in skew.attach_totals(df, ["k"], {"s": F.sum("v")}, nullable=True).collect())
    assert got == [(1.0, 3.0), (2.0, 3.0), (5.0, 5.0)]


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "z")], "k int, o int, x string")
    assert sorted((r.k, r.x) for r in skew.first_per_key(df, ["k"], ["o"]).collect()) == [(1, "a"), (2, "z")]
    assert sorted((r.k, r.x) for r in skew.first_per_key(df, ["k"], ["o"], last=True).collect()) == [(1, "c"), (2, "z")]


def test_rescale_and_z_on_constant_groups(spark):
    df = spark.createDataFrame([("c", 4.0), ("c", 4.0), ("d", 1.0), ("d", 3.0)], "k string, v double")
    assert sorted(r.u for r in windows.rescale_min_max(df, ["k"], "v", "u").collect()) == [0.0, 0.5, 0.5, 1.0]
    z = {(r.k, r.v): r.z for r in windows.z_score(df, ["k"], "v", "z").collect()}
    assert z[("c", 4.0)] is None and z[("d", 3.0)] == pytest.approx(1 / math.sqrt(2))


def test_join_fixtures(spark):
    """Three cells by three months with one missing pair."""
    a = spark.createDataFrame([(c, m, 1) for c in (1, 2, 3) for m in (1, 2, 3) if (c, m) != (2, 3)], "c int, m int, x int")
    full = reshape.complete(a, ["c"], a.select("m"), {"x": 0})
    assert full.count() == 9 and full.where("c = 2 AND m = 3").first().x == 0
    b = spark.createDataFrame([(2, 3, 5), (9, 9, 6)], "c int, m int, x int")
    j = joins.full_join_suffixed(a, b, ["c", "m"])
    assert j.count() == 10 and set(j.columns) == {"c", "m", "x_x", "x_y"}
    assert joins.keep_matching(a, b, ["c"]).count() == 2
    assert joins.drop_matching(a, b, ["c", "m"]).count() == 8
    with pytest.raises(ValueError):
        joins.join_checked(b, a, ["c"])


def test_interval_join_edges_and_hot_key(spark):
    left = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k, date_add(date'2000-01-01', cast(id % 900 as int)) AS d, id FROM range(1200)")
    right = spark.sql("SELECT id % 50 AS k, date_add(date'2000-01-01', cast(id * 17 % 500 as int)) AS b, date_add(date'2000-01-01', cast(id * 17 % 500 + 400 as int)) AS e, id AS p FROM range(100)")
    got = joins.interval_join(left, right, "k", "d", "b", "e")
    plain = left.join(right.withColumnRenamed("k", "k2"), F.expr("k = k2 AND d BETWEEN b AND e"))
    assert sorted((r.id, r.p) for r in got.collect()) == sorted((r.id, r.p) for r in plain.collect())
    assert joins.interval_join(left, right, "k", "d", "b", "e", "left").where("p is null").count() > 0


def test_range_join_bounds(spark):
    v = spark.createDataFrame([(float(x),) for x in (0, 5, 10, 12)], "v double")
    bands = spark.createDataFrame([(0.0, 5.0, "a"), (5.0, 10.0, "b")], "lo double, hi double, n string")
    assert sorted((r.v, r.n) for r in joins.range_join(v, bands, "v", "lo", "hi", 4.0).collect()) == [(0.0, "a"), (5.0, "b")]
    assert sorted((r.v, r.n) for r in joins.range_join(v, bands, "v", "lo", "hi", 4.0, left_open=True).collect()) == [(5.0, "a"), (10.0, "b")]


@pytest.mark.parametrize("k", [1, 4])
def test_k_nearest_matches_brute_force(spark, k):
    rng = random.Random(3)
    left = [(i, float(rng.randrange(0, 64)), float(rng.randrange(0, 64))) for i in range(120)]
    # A third of the targets in one corner, the rest sparse, so that near and far levels are both used.
    right = [(i, round(rng.uniform(0, 3), 3), round(rng.uniform(0, 3), 3)) if i % 3 == 0 else (i, round(rng.uniform(0, 64), 3), round(rng.uniform(0, 64), 3)) for i in range(30)]
    l = spark.createDataFrame(left, "lid int, x double, y double")
    r = spark.createDataFrame(right, "rid int, x double, y double")
    got = {(p.lid, p.rank): p.rid for p in spatial.k_nearest(l, r, ["lid"], "rid", k).collect()}
    for lid, x, y in left:
        best = sorted((math.dist((x, y), (a, b)), rid) for rid, a, b in right)[:k]
        assert [got[(lid, i + 1)] for i in range(k)] == [rid for _, rid in best]


def test_far_neighbours_are_found(spark):
    """Points thousands of bucket widths apart, alone in their slices or not."""
    l = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 5000.0, 0.0), (3, "b", -7e6, 3e6), (4, "none", 0.0, 0.0)], "lid int, s string, x double, y double")
    r = spark.createDataFrame([(1, "a", 5001.0, 0.0), (2, "a", 9000.0, 0.0), (3, "b", 9e6, -2e6)], "rid int, s string, x double, y double")
    near = {p.lid: (p.rid, p.dist) for p in spatial.nearest(l, r, ["lid"], "rid", ["s"]).collect()}
    assert near == {1: (1, 5001.0), 2: (1, 1.0), 3: (3, math.dist((-7e6, 3e6), (9e6, -2e6)))}
    two = {(p.lid, p.rank): p.rid for p in spatial.k_nearest(l, r, ["lid"], "rid", 2, ["s"]).collect()}
    assert two == {(1, 1): 1, (1, 2): 2, (2, 1): 1, (2, 2): 2, (3, 1): 3}


def test_inverse_distance_of_a_large_slice(spark):
    """A slice of 100,000 samples is folded in blocks; the sums add up to those of one fold."""
    s = spark.range(100_000).select(F.lit(1).alias("day"), (F.col("id") % 500).cast("double").alias("x"), F.floor(F.col("id") / 500).cast("double").alias("y"), (F.col("id") % 11).cast("double").alias("v"))
    t = spark.createDataFrame([(1, 1, 20.5, 7.25), (2, 1, 30.0, 40.0), (3, 2, 0.0, 0.0)], "cell int, day int, x double, y double")
    got = {r.cell: r.v for r in spatial.idw(t, s, ["cell"], ["day"], "v").collect()}
    w = [(1 / math.dist((20.5, 7.25), (i % 500, i // 500)), i % 11) for i in range(100_000)]
    assert got[1] == pytest.approx(sum(a * b for a, b in w) / sum(a for a, _ in w)) and got[2] == (30 + 40 * 500) % 11 and set(got) == {1, 2}


def test_kolmogorov_tail(spark):
    """Equal samples, nearly equal large ones, and the plain series with many terms."""
    plain = lambda x: 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 4000))
    xs = [0.05, 0.3, 0.7, 0.999, 1.0, 1.001, 1.36, 2.5]
    got = spark.createDataFrame([(x,) for x in [0.0, *xs]], "x double").select("x", stats.kolmogorov_tail(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in got} == {0.0: 1.0} | {x: pytest.approx(plain(x), abs=1e-12) for x in xs}
    both = spark.range(2000).select((F.col("id") % 1000).alias("v"), (F.col("id") < 1000).alias("f"))
    r = stats.ks_two_sample(both, "v", F.col("f")).first()
    assert (r.d, r.p_value) == (0.0, 1.0)


def test_full_join_with_a_hot_key(spark):
    a = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    b = spark.createDataFrame([(0, "x"), (5000, "y"), (None, "z")], "k long, b string")
    got = joins.full_join(a, b, ["k"]).collect()
    assert len(got) == 902 and sum(r.b == "x" for r in got) == 300 and {r.b for r in got if r.a is None} == {"y", "z"}


def test_large_dimension_is_refused(spark):
    few, many = spark.range(3), spark.range(joins.DIMENSION_ROWS + 1).withColumnRenamed("id", "d")
    assert joins.with_dimension(few, many.limit(10)).count() == 30
    with pytest.raises(Exception, match="dimension has more"):
        joins.with_dimension(few, many).collect()


def test_pivot_refuses_unlisted_values(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 3)], "k string, p string, v int")
    wide = {r.k: (r.x, r.y) for r in reshape.pivot_values(df, ["k"], "p", ["x", "y"], {"v": F.sum("v")}).collect()}
    assert wide == {"a": (1, 2), "b": (None, None)}
    with pytest.raises(Exception, match="not listed"):
        reshape.pivot_values(df, ["k"], "p", ["x"], {"v": F.sum("v")}).collect()


def test_fewer_than_k_samples(spark):
    l = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "lid int, x double, y double")
    r = spark.createDataFrame([(1, 3.0, 4.0, 2.0), (2, 60.0, 60.0, 4.0)], "rid int, x double, y double, v double")
    got = {p.lid: (p.v, p.n_used) for p in spatial.knn_mean(l, r, ["lid"], "rid", "v", 4).collect()}
    assert got == {1: (3.0, 2), 2: (3.0, 2)}


def test_idw_exact_hit_and_mean(spark):
    s = spark.createDataFrame([("t", 0.0, 0.0, 10.0), ("t", 2.0, 0.0, 20.0)], "t string, x double, y double, v double")
    p = spark.createDataFrame([(1, "t", 0.0, 0.0), (2, "t", 1.0, 0.0), (3, "t", 0.5, 0.0)], "c int, t string, x double, y double")
    got = {r.c: r.v for r in spatial.idw(p, s, ["c"], ["t"], "v").collect()}
    assert got[1] == 10.0 and got[2] == pytest.approx(15.0) and got[3] == pytest.approx(12.5)


def test_areal_overlay_conserves_and_weights(spark):
    src = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 10.0), (1.0, 0.0, 2.0, 1.0, 20.0), (8.0, 8.0, 9.0, 9.0, 5.0)], "x0 double, y0 double, x1 double, y1 double, v double")
    tgt = spark.createDataFrame([(1, 0.5, 0.0, 1.5, 1.0), (2, 0.0, 0.0, 1.0, 1.0), (3, 4.0, 4.0, 5.0, 5.0)], "c int, x0 double, y0 double, x1 double, y1 double")
    got = {r.c: (r.v, r.covered_area) for r in spatial.areal_overlay(src, tgt, "c", "v", size=1.0).collect()}
    assert got == {1: (15.0, 1.0), 2: (10.0, 1.0)}


def test_box_pairs_have_no_duplicates(spark):
    rng = random.Random(5)
    box = lambda: (lambda a, b: (a, b, a + rng.uniform(0.1, 5), b + rng.uniform(0.1, 5)))(rng.uniform(0, 20), rng.uniform(0, 20))
    ls, rs = [(i, *box()) for i in range(60)], [(i, *box()) for i in range(60)]
    l = spark.createDataFrame(ls, "a int, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame(rs, "b int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((p.a, p.b) for p in spatial.box_pairs(l, r, 2.0).collect())
    want = sorted((i, j) for i, x0, y0, x1, y1 in ls for j, u0, v0, u1, v1 in rs if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1)
    assert got == want


def test_ks_and_rank_sum_with_ties(spark):
    a, b = [1, 2, 2, 3, 5, 5, 8], [2, 3, 3, 6, 7, 9, 9, 9]
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b], "v double, g boolean")
    r = stats.ks_two_sample(df, "v", F.col("g")).first()
    cdf = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    assert r.d == pytest.approx(max(abs(cdf(a, v) - cdf(b, v)) for v in a + b))
    w = stats.rank_sum_test(df, "v", F.col("g")).first()
    pooled = sorted(a + b)
    rank = lambda v: statistics.mean(i + 1 for i, x in enumerate(pooled) if x == v)
    assert w.w == pytest.approx(sum(rank(v) for v in a) - len(a) * (len(a) + 1) / 2)


def test_gaussian_and_tweedie_fits(spark):
    rows = [(float(x), 3.0 + 2.0 * x + (-1) ** x * 0.1, math.exp(0.5 + 0.2 * x)) for x in range(20)]
    df = spark.createDataFrame(rows, "x double, y double, t double")
    m = stats.fit_glm(df, "y", ["x"])
    assert m.coefficients[0] == pytest.approx(2.0, abs=0.01) and m.intercept == pytest.approx(3.0, abs=0.1)
    t = stats.fit_tweedie(df, "t", ["x"])
    assert t.coefficients[0] == pytest.approx(0.2, abs=1e-4) and t.intercept == pytest.approx(0.5, abs=1e-3)
    table = stats.coefficient_table(spark, {"m": (m, ["x"])})
    assert {r.term for r in table.collect()} == {"(intercept)", "x"}


def test_year_forward_uses_only_earlier_years(spark):
    rows = [(y, float(x), 1.0 + x + 0.01 * ((x * 7 + y) % 3) + (100.0 if y == 2003 else 0.0)) for y in (2001, 2002, 2003) for x in range(10)]
    df = spark.createDataFrame(rows, "year int, x double, y double")
    got = {r.year: r for r in stats.year_forward_scores(df, "y", ["x"], "year", [2002, 2003]).collect()}
    assert got[2002].rmse < 0.1 and got[2003].rmse == pytest.approx(100.0, abs=0.1) and got[2002].log_score > got[2003].log_score


def test_mean_ci(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0)], "k string, v double")
    got = {r.k: r for r in aggs.mean_ci(df, ["k"], "v").collect()}
    assert got["a"].hi - got["a"].mean == pytest.approx(4.302653 / math.sqrt(3), rel=1e-5)
    assert got["b"].lo is None


def test_contracts_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, r string")
    with pytest.raises(ValueError):
        aggs.require_functional_dep(df, ["k"], "r")


def test_correlations_of_two_hundred_columns(spark):
    """One pass over all pairs, with nulls in every column, equal to the built-in aggregate."""
    n = 200
    cols = [(F.when(F.hash(F.col("id"), F.lit(i)) % 7 != 0, F.sin(F.col("id") * (i + 1)) + F.col("id") * (i % 3) / 50 + 1e6 * (i % 2))).alias(f"c{i}") for i in range(n)]
    df = spark.range(300).select(*cols, F.lit(1.0).alias("flat"), F.lit(None).cast("int").alias("none"))
    got = {(r.var_a, r.var_b): r.r for r in stats.correlation_matrix(df, df.columns).collect()}
    assert len(got) == (n + 2) * (n + 1) // 2
    some = [("c0", "c1"), ("c3", "c150"), ("c2", "c5"), ("c198", "c199"), ("c7", "c8")]
    want = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}{b}") for a, b in some]).first()
    assert [got[p] for p in some] == [pytest.approx(v, abs=1e-7) for v in want]
    assert got["c0", "flat"] is None and got["c0", "none"] is None

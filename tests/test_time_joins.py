"""As-of and interval joins against brute force, with hot keys and crowded intervals."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.asof import asof_join
from tidegrid.operators.joins import interval_join


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_equals_brute_force(spark, direction, tolerance):
    rng = random.Random(3)
    left = [(i, rng.choice(["hot", "hot", "b", "none", None]), rng.choice([None, *range(60)])) for i in range(400)] + [(7, "hot", 5)] * 2
    right = [(rng.choice(["hot", "b", None]), rng.choice([None, *range(0, 60, 2)]), rng.randint(0, 9)) for _ in range(60)]
    got = asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, due int, v int"), ["k"], "t", "due", ["v"], tolerance, direction, 5)

    def due(k, t):
        at = {}
        for key, when, v in right:
            if key == k and k is not None and t is not None and when is not None:
                at[when] = max(at.get(when, -1), v)
        ok = {"backward": lambda w: w <= t, "forward": lambda w: w >= t, "nearest": lambda w: True}[direction]
        best = min((w for w in at if ok(w)), key=lambda w: (abs(w - t), w), default=None)
        return (None, None) if best is None or (tolerance is not None and abs(best - t) > tolerance) else (best, at[best])

    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, k, t, *due(k, t)) for i, k, t in left), key=str)


def test_asof_of_dates_and_timestamps(spark):
    l = spark.sql("SELECT 1 AS k, DATE '2020-01-10' AS d, TIMESTAMP '2020-01-10 00:00:30' AS s")
    r = spark.sql("SELECT 1 AS k, DATE '2020-01-01' AS rd, TIMESTAMP '2020-01-09 23:59:59' AS rs, 'v' AS v")
    assert asof_join(l, r, ["k"], "d", "rd", ["v"], 9).first().v == "v" and asof_join(l, r, ["k"], "d", "rd", ["v"], 8).first().v is None
    assert asof_join(l, r, ["k"], "s", "rs", ["v"], 31).first().v == "v" and asof_join(l, r, ["k"], "s", "rs", ["v"], 30).first().v is None


def test_intervals_equal_brute_force(spark):
    rng = random.Random(4)
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(n)
    left = [(i, rng.choice(["hot", "hot", "b", "c", None]), day(rng.choice([None, *range(100)]))) for i in range(300)]
    right = [(p, rng.choice(["hot"] * 9 + ["b", None]), *[day(n) for n in (a, a + rng.choice([0, 1, 5, 40, 90]))]) for p in range(80) for a in [rng.randint(-5, 100)]]
    right += [(900, "b", day(9), day(3)), (901, "b", None, day(50)), (902, "hot", day(3), None), (903, "c", day(200), day(300)), (904, "hot", day(5), day(5)), (904, "hot", day(5), day(5))]
    l, r = spark.createDataFrame(left, "i int, k string, d date"), spark.createDataFrame(right, "p int, k string, b date, e date")
    want = sorted((i, p) for i, k, d in left for p, q, b, e in right if k == q and None not in (k, d, b, e) and b <= d <= e)
    assert sorted((x.i, x.p) for x in interval_join(l, r, "k", "d", "b", "e").collect()) == want
    lone = {i for i, _, _ in left} - {i for i, _ in want}
    full = interval_join(l, r, "k", "d", "b", "e", "left").collect()
    assert sorted((x.i, x.p) for x in full if x.p is not None) == want and sorted(x.i for x in full if x.p is None) == sorted(lone)


def test_thousands_of_overlapping_permits_of_one_vessel(spark):
    """A vessel with half of all rows and 4,000 permits that all overlap: work stays near the size of the result."""
    right = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("p"), F.col("id").alias("b"), (F.col("id") + 4000).alias("e"))
    left = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("k"), (F.col("id") * 4).alias("t"))
    got = interval_join(left, right, "k", "t", "b", "e")
    want = sum(1 for i in range(0, 2000, 2) for t in [4 * i] for _ in range(max(0, t - 4000), min(3999, t) + 1))
    assert got.count() == want
    assert got.select("t", "p").distinct().count() == want

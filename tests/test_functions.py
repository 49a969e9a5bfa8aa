"""Scalar rules on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import calendar as cal
from tidegrid.functions import nulls as nl
from tidegrid.functions import scalars as sc
from tidegrid.functions.geometry import in_ring, point, ring_meets_box, to_utm
from tidegrid.operators.aggs import t_factor, t_quantile

D = dt.date


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize(
    "day, crab, season, licence, half",
    [
        (D(2009, 10, 31), "2008_2009", "2008-2009", "2009-2010", "October_2"),
        (D(2009, 11, 1), "2009_2010", "2008-2009", "2009-2010", "November_1"),
        (D(2009, 11, 30), "2009_2010", "2008-2009", "2009-2010", "November_2"),
        (D(2009, 12, 1), "2009_2010", "2009-2010", "2009-2010", "December_1"),
        (D(2010, 9, 30), "2009_2010", "2009-2010", "2009-2010", "September_2"),
        (D(2012, 2, 29), "2011_2012", "2011-2012", "2011-2012", "February_2"),
        (D(2012, 5, 15), "2011_2012", "2011-2012", "2011-2012", "May_1"),
        (D(2012, 5, 16), "2011_2012", "2011-2012", "2011-2012", "May_2"),
    ],
)
def test_three_season_calendars(spark, day, crab, season, licence, half):
    d = F.lit(day)
    r = one(spark, a=cal.crab_year(d), b=cal.season(d), c=cal.licence_season(d), h=cal.half_month(d))
    assert (r.a, r.b, r.c, r.h) == (crab, season, licence, half)


def test_weeks_are_seven_day_blocks(spark):
    r = one(spark, a=cal.week7(F.lit(D(2010, 1, 1))), b=cal.week7(F.lit(D(2010, 1, 8))), c=cal.week7(F.lit(D(2012, 12, 31))))
    assert (r.a, r.b, r.c) == (1, 2, 53)


def test_year_repair_and_leap_day(spark):
    y = F.lit(2009)
    r = one(
        spark, out=cal.repair_year(F.lit(D(2011, 1, 5)), y), ok=cal.repair_year(F.lit(D(2010, 1, 5)), y),
        leap=cal.repair_year(F.lit(D(2012, 2, 29)), F.lit(2010)), leap_out=cal.repair_year(F.lit(D(2012, 2, 29)), F.lit(2009)),
    )
    assert (r.out, r.ok, r.leap, r.leap_out) == (D(2010, 1, 5), D(2010, 1, 5), D(2011, 2, 28), D(2011, 2, 28))


def test_season_start_text(spark):
    r = one(spark, a=cal.parse_season_start(F.lit("Dec. 15"), F.lit(2013)), b=cal.parse_season_start(F.lit("Jan. 4"), F.lit(2013)), c=cal.parse_season_start(F.lit("soon"), F.lit(2013)))
    assert (r.a, r.b, r.c) == (D(2013, 12, 15), D(2014, 1, 4), None)


def test_anchor_dates(spark):
    cy = F.lit("2009_2010")
    r = one(spark, a=cal.anchor_date(F.lit(11), F.lit(23), cy), b=cal.anchor_date(F.lit(4), F.lit(1), cy), c=cal.anchor_date(F.lit(None).cast("int"), F.lit(1), cy))
    assert (r.a, r.b, r.c) == (D(2009, 11, 23), D(2010, 4, 1), None)


def test_interval_edges(spark):
    rows = spark.createDataFrame([(float(v),) for v in (-1, 0, 5, 10, 11)], "x double").select(
        sc.find_interval("x", [0, 5, 10]).alias("l"), sc.find_interval("x", [0, 5, 10], left_open=True).alias("r"),
        sc.cut_labels("x", [0, 5, 10], ["a", "b"]).alias("cut"),
    ).collect()
    assert [r.l for r in rows] == [0, 1, 2, 3, 3]
    assert [r.r for r in rows] == [0, 0, 1, 2, 3]
    assert [r.cut for r in rows] == [None, None, "a", "b", None]


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None), (3, 4.0)], "g int, x double")
    got = {r.g: (r.strict, r.loose, r.n) for r in df.groupBy("g").agg(nl.strict_sum("x").alias("strict"), nl.sum_or_zero("x").alias("loose"), nl.n_distinct_with_null("x").alias("n")).collect()}
    assert got == {1: (None, 2.0, 2), 2: (None, 0.0, 1), 3: (4.0, 4.0, 1)}
    n = F.lit(None).cast("double")
    r = one(spark, a=nl.if_na_safe(n > 1, F.lit(1), F.lit(0)), b=nl.in_set(n, [1.0]), c=nl.later_of(n, F.lit(2.0)), d=nl.number_or_null(F.lit("12x")), e=sc.concat_key(F.lit("a"), n))
    assert (r.a, r.b, r.c, r.d, r.e) == (None, False, None, None, None)
    with pytest.raises(ValueError):
        nl.require_columns(df, ["g", "missing"])


def test_normal_tails(spark):
    """Published tail probabilities, far out too."""
    known = {1.959963985: 0.05, -1.0: 0.3173105079, 0.0: 1.0, 8.0: 1.2441921149e-15, 12.0: 3.552964e-33}
    r = one(spark, **{f"p{i}": sc.two_sided_normal(F.lit(z)) for i, z in enumerate(known)})
    for got, want in zip(r, known.values()):
        assert abs(got / want - 1) < 1e-6


def test_t_quantiles(spark):
    """Table values for few and many degrees of freedom, and a far tail at one."""
    assert abs(t_quantile(0.975, 1) - 12.7062047362) < 1e-8
    assert abs(t_quantile(0.975, 10) - 2.2281388520) < 1e-8
    assert abs(t_quantile(0.99995, 1) - 6366.1976692) < 1e-3
    known = {1: 12.7062047362, 31: 2.0395134464, 60: 2.0002978220, 61: 1.9996235850, 99: 1.9842169516, 9999: 1.9602012636}
    r = one(spark, **{f"t{d}": t_factor(0.95, F.lit(d)) for d in known})
    for got, want in zip(r, known.values()):
        assert abs(got - want) < 1e-7


def test_polygon_rules(spark):
    ring = F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    r = one(
        spark, inside=in_ring(F.lit(1.0), F.lit(0.5), ring), notch=in_ring(F.lit(2.0), F.lit(3.0), ring),
        arm=in_ring(F.lit(3.8), F.lit(3.0), ring), out=in_ring(F.lit(9.0), F.lit(1.0), ring),
        crossing=ring_meets_box(ring, F.lit(-1.0), F.lit(0.2), F.lit(9.0), F.lit(0.4)),
        inner=ring_meets_box(ring, F.lit(1.0), F.lit(0.2), F.lit(1.2), F.lit(0.3)),
        apart=ring_meets_box(ring, F.lit(1.9), F.lit(3.0), F.lit(2.1), F.lit(3.5)),
    )
    assert (r.inside, r.notch, r.arm, r.out, r.crossing, r.inner, r.apart) == (True, False, True, False, True, True, False)


def test_utm_known_points(spark):
    # On the central meridian the easting is 500 km; the northing at 45 N is a published value.
    e = to_utm(F.lit(-123.0), F.lit(45.0))
    r = one(spark, e=e["easting"], n=e["northing"])
    assert abs(r.e - 500000.0) < 1e-6 and abs(r.n - 4982950.400) < 0.01
    w = to_utm(F.lit(-124.0), F.lit(0.0))
    r = one(spark, e=w["easting"], n=w["northing"])
    assert abs(r.n) < 1e-6 and abs(r.e - 388723.0) < 60 and not math.isnan(r.e)

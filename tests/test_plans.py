"""Domain rules: conservation, guards, boundaries, and the shape of the plans."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidegrid.plans import effort as eff
from tidegrid.plans import features as ft
from tidegrid.plans import logbook as lb
from tidegrid.plans import risk as rk
from tidegrid.plans import scenario as sn
from tidegrid.plans import tradeoff as tr
from tidegrid.plans.effort import METRICS
from tidegrid.plans.scenario import Scenario
from tidegrid.registry.bindings import Tables

SF = "/root/testdata/sf0.001"
D = dt.date


def tiny_effort(spark, rows):
    """(date, cell, region, pings) rows of one crab year."""
    data = [("2009_2010", d, c, r, -50.0 - c, c % 2 == 0, float(p), 10.0 * p, int(p), p / 10, 1) for d, c, r, p in rows]
    return spark.createDataFrame(
        data, "crab_year string, date date, cell_id long, region string, depth double, bia boolean, lbs double, rev double, pings long, vessel_share double, vessels int"
    )


ROWS = [
    (D(2009, 11, 20), 1, "CenCA", 4), (D(2009, 12, 20), 1, "CenCA", 2), (D(2010, 4, 10), 2, "CenCA", 6),
    (D(2010, 4, 12), 3, "NorCA", 1), (D(2010, 4, 20), 4, "NorCA", 3), (D(2010, 5, 2), 1, "CenCA", 5),
    (D(2010, 1, 3), 5, "WA", 7),
]


def total(df, col="pings", where="true"):
    return df.where(where).agg(F.coalesce(F.sum(col), F.lit(0.0))).first()[0]


def test_temporal_closure_conserves_and_flags_missing_base(spark):
    s = Scenario("t", closure=(4, 1), closure_method="temporal", closure_regions=("CenCA",))
    out = sn.run_scenarios(tiny_effort(spark, ROWS), [s])
    assert total(out) == pytest.approx(28.0)
    # April's six pings go to NorCA one to three; May has no base there and stays, flagged.
    assert total(out, where="region = 'NorCA'") == pytest.approx(10.0)
    assert total(out, where="cell_id = 4") == pytest.approx(3 + 6 * 3 / 4)
    assert total(out, where="nobase") == pytest.approx(5.0) and total(out, where="cell_id = 1 AND nobase") == pytest.approx(5.0)


def test_partial_redistribution_loses_the_rest(spark):
    s = Scenario("t", closure=(4, 1), closure_method="temporal", closure_regions=("CenCA",), closure_pct=60.0)
    assert total(sn.run_scenarios(tiny_effort(spark, ROWS), [s])) == pytest.approx(28.0 - 0.4 * 11)


@pytest.mark.parametrize("metric", METRICS)
def test_every_metric_is_conserved_on_real_rows(spark, metric):
    t = Tables(spark, SF)
    s = [Scenario("sq"), Scenario("bia", closure=(4, 1), closure_method="temporal", closure_regions=("BIA",))]
    out = sn.run_scenarios(t.effort, s).groupBy("scenario").agg(F.sum(metric).alias("v")).collect()
    v = {r.scenario: r.v for r in out}
    assert v["sq"] == pytest.approx(v["bia"])


def test_lag_and_pile_shift_dates(spark):
    e = tiny_effort(spark, ROWS)
    lag = sn.run_scenarios(e, [Scenario("l", delay=(12, 1), delay_method="lag", delay_regions=("CenCA",), preseason_days=0)])
    # The season starts Nov 20, the opening is eleven days later: every CenCA row moves by eleven days.
    assert {r.date for r in lag.where("region = 'CenCA'").collect()} == {D(2009, 12, 1), D(2009, 12, 31), D(2010, 4, 21), D(2010, 5, 13)}
    pile = sn.run_scenarios(e, [Scenario("p", delay=(12, 1), delay_method="pile", delay_regions=("CenCA",), preseason_days=0)])
    assert {r.date for r in pile.where("region = 'CenCA'").collect()} == {D(2009, 12, 1), D(2009, 12, 20), D(2010, 4, 10), D(2010, 5, 2)}


def test_early_delay_is_never_negative(spark):
    out = sn.run_scenarios(tiny_effort(spark, ROWS), [Scenario("l", delay=(11, 2), delay_method="lag", preseason_days=0)])
    assert {r.date for r in out.collect()} == {r[0] for r in ROWS}


def test_early_data_pile_keeps_and_remove_drops(spark):
    rows = ROWS + [(D(2009, 11, 2), 1, "CenCA", 9)]
    pile = sn.run_scenarios(tiny_effort(spark, rows), [Scenario("p", early_method="pile")])
    drop = sn.run_scenarios(tiny_effort(spark, rows), [Scenario("r")])
    assert total(pile) == pytest.approx(37.0) and pile.where("date = DATE'2009-11-10'").count() == 1
    assert total(drop) == pytest.approx(28.0)


def test_compact_gives_one_row_per_cell_and_date(spark):
    s = Scenario("t", closure=(4, 1), closure_method="temporal", closure_regions=("CenCA",))
    loose = sn.run_scenarios(tiny_effort(spark, ROWS), [s])
    tight = sn.run_scenarios(tiny_effort(spark, ROWS), [s], compact=True)
    assert tight.count() == tight.select("cell_id", "date", "nobase").distinct().count() < loose.count()
    assert total(tight) == pytest.approx(total(loose))


@pytest.mark.parametrize(
    "bad",
    [
        dict(delay=(12, 1)), dict(closure=(4, 1), closure_method="temporal"), dict(closure=(4, 1), closure_method="remove", closure_regions=("All", "WA")),
        dict(delay=(12, 1), delay_method="lag", before=(1, 1), before_pct=10.0), dict(after_redist=True), dict(closure_pct=120.0),
        dict(delay=(4, 1), delay_method="remove", closure=(1, 1), closure_method="remove"), dict(early_method="ignore"), dict(depth_deep=5.0),
    ],
)
def test_meaningless_scenarios_are_refused(bad):
    with pytest.raises(ValueError):
        Scenario("x", **bad).check()


def test_scenario_grid_numbers_and_names():
    rows = sn.scenario_grid([Scenario("a"), Scenario("b")], {"delay_fidelity": ["spatial", "temporal"], "closure_pct": [10.0, 100.0]})
    assert len(rows) == 8 and {r.scenario_number for r in rows} == {1, 2} and len({r.scenario for r in rows}) == 8


def test_status_quo_is_its_own_baseline(spark):
    r = {x.scenario: x for x in entry.queries()["scenario_tradeoff"](spark, SF).where("crab_year = '1996_1997'").collect()}
    sq = r["status_quo"]
    assert (sq.rel_risk_hump, sq.rel_rev, sq.rel_lbs) == (0.0, 100.0, 100.0)
    assert r["close_remove"].rel_rev < 100.0


def test_benefit_cost_guards(spark):
    df = spark.createDataFrame([("a", 99.5, 10.0, -2.0), ("b", 80.0, 10.0, 5.0)], "scenario string, rel_rev double, rel_n_risk_hump double, rel_n_risk_blue double")
    got = {r.scenario: (r.bc_hump, r.bc_blue) for r in tr.benefit_cost(df).collect()}
    assert got == {"a": (10.0, 0.0), "b": (0.5, 0.25)}


def test_effort_shares_sum_to_trips_even_for_a_hot_ticket(spark):
    p = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN 0 ELSE id % 97 END AS ticket_id, 1L AS vessel_id, date'2010-01-01' AS date, id % 11 AS cell_id, 2.0D AS lbs, 3.0D AS rev FROM range(5000)")
    e = eff.effort_daily(p)
    assert total(e) == 5000 and total(e, "vessel_share") == pytest.approx(97.0) and total(e, "lbs") == pytest.approx(10000.0)


def test_effort_is_not_computed_in_the_tasks_of_the_join(spark):
    """Pings from a join on the ticket are dealt out by number, before they are aggregated and before the window."""
    plan = entry.queries()["effort_daily"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^()]*), \d+\), REPARTITION_BY_NUM", plan)
    assert sorted(re.sub(r"#\d+L?", "", d) for d in dealt) == ["ticket_id", "ticket_id, cell_id"]


def test_normalise_floor(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "p double")
    assert sorted(r.n for r in eff.normalize_floor(df, "p", "n").collect()) == [0.125, 0.25, 1.0]


def test_suppression_threshold(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0)], "c string, v int, x double")
    got = {r.c: (r.x, r.confidential) for r in eff.suppress(df, ["c"], "v", ["x"]).collect()}
    assert got == {"a": (None, True), "b": (3.0, False)}


def test_line_filters_and_endpoint_rule(spark):
    df = spark.createDataFrame([(1, 0.0, 51), (2, 0.0, 50), (3, 80000.0, 5), (4, 79999.0, 5)], "i int, len double, pots int")
    assert sorted(r.i for r in lb.filter_lines(df, "len", "pots").collect()) == [2, 4]
    pts = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 3.0, 4.0), ("b", 1, 0.0, 0.0), ("c", 1, 0.0, 0.0), ("c", 2, 1.0, 1.0), ("c", 3, 2.0, 2.0)], "s string, q int, x double, y double")
    assert [r.s for r in lb.endpoints_to_lines(pts, "s", "q", "x", "y", []).collect()] == ["a"]
    deep = spark.createDataFrame([(-10.0,), (-300.0,), (-10000.0,), (5.0,)], "d double")
    assert sorted(r.d for r in lb.filter_depth(deep, "d").collect()) == [-10000.0, -10.0]


def test_expansion_restores_the_total(spark):
    df = spark.createDataFrame([("p", 3.0), ("p", 6.0)], "k string, n double")
    assert total(lb.expand_sample(df, ["k"], "n", 0.3), "expanded") == pytest.approx(30.0)


def test_displacement_conserves_and_spreads_evenly(spark):
    rows = [(1, "R", "s", 1, 1.0, 0.0, 2.0), (2, "R", "s", 1, 1.0, 0.0, 2.0), (1, "R", "s", 4, 1.0, 8.0, 2.0)]
    df = spark.createDataFrame(rows, "cell_id int, region string, crab_year string, month int, dens double, pings double, area double")
    out = rk.displace(df, [4], 1).collect()
    assert sorted(r.pings for r in out) == [4.0, 4.0]


def test_overlap_rules(spark):
    df = spark.createDataFrame([(0.0, None), (None, 2.0), (3.0, None), (3.0, 2.0)], "e double, s double")
    assert [r.r for r in df.select(rk.overlap_risk(df, "e", "s").alias("r")).collect()] == [0.0, 0.0, None, 6.0]


def test_prediction_error_counts_missing_values(spark):
    df = spark.createDataFrame([("c", D(2010, 1, 1), 1.0), ("c", D(2010, 1, 2), 3.0), ("c", D(2010, 1, 3), None), ("d", D(2010, 1, 3), None)], "c string, d date, x double")
    got = {r.c: r for r in rk.aggregate_predictions(df, ["c"], "d", "x", F.trunc("d", "month").cast("date")).collect()}
    assert got["c"].mean == 2.0 and got["c"].se == pytest.approx((2.0 / 3) ** 0.5) and got["d"].se is None


def test_imputation_uses_both_neighbours(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, None)], "k string, s int, v double")
    assert [r.v for r in ft.impute_slice(df, ["k"], "s", "v").orderBy("s").collect()] == [2.0, 4.0, 6.0, 6.0]


def test_cell_month_is_cheap(spark):
    """Quantile queries read the staged cell-months: few scans and no window over tickets."""
    for name in ("risk_by_habitat_class", "quantiles_wide"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Scan parquet") + plan.count("Scan ExistingRDD") <= 8 and "ticket_id" not in plan, name


def test_scenario_table_round_trip(spark):
    """Absent values, dates and lists of regions survive; wrong tables are refused."""
    own = [sn.Scenario("b", delay=(12, 15), delay_method="lag", delay_regions=("OR", "WA")), sn.Scenario("a", after=(3, 1), after_pct=12.5, after_redist=True, after_regions=("CenCA",))]
    table = sn.scenario_table(spark, own)
    assert sn.scenarios_from_table(table) == sorted(own, key=lambda s: s.scenario)
    some = spark.createDataFrame([("x", "NULL", None, "04-01", "depth", "-20", "-100")], "scenario string, delay string, before string, closure string, closure_method string, depth_shallow string, depth_deep string")
    assert sn.scenarios_from_table(some) == [sn.Scenario("x", closure=(4, 1), closure_method="depth", depth_shallow=-20.0, depth_deep=-100.0)]
    for bad in (table.withColumn("colour", F.lit("red")), table.unionByName(table), table.drop("scenario"), table.withColumn("delay_regions", F.lit("Atlantis"))):
        with pytest.raises(ValueError):
            sn.scenarios_from_table(bad)


HEAVY = ["effort_daily", "points_in_polygons", "areal_weighted_overlay", "mean_of_four_nearest", "distance_to_closed_cells", "permit_interval_join", "scenario_tradeoff", "inverse_distance_grid", "quantiles_wide"]


@pytest.mark.parametrize("name", HEAVY)
def test_plans_have_no_python_and_no_all_pairs_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, f"{name}: {word}"

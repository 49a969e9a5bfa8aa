"""Management scenarios, from single rules to the full sweep with trade-offs and ranks."""

from pyspark.sql import functions as F

from ..plans import risk as rk
from ..plans import scenario as sn
from ..plans import tradeoff as tr
from ..plans.effort import METRICS
from ..plans.scenario import Scenario
from .bindings import CTES, anchor_sql, crab_year_sql
from .core import query

M = ", ".join(METRICS)
SUMS = ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in METRICS)
DBL = "lbs:5 rev:3 pings:6 vessel_share:8 vessels:6"

CTES["starts"] = """SELECT crab_year, region, min(date) AS first_date, make_date(CAST(substr(crab_year, 1, 4) AS INT), 11, CASE region WHEN 'CenCA' THEN 10 ELSE 26 END) AS backstop
    FROM effort GROUP BY 1, 2"""
CTES["eff0"] = """SELECT e.*, greatest(first_date - 3, backstop) AS season_start FROM effort e JOIN starts USING (crab_year, region) WHERE date >= greatest(first_date - 3, backstop)"""

OPEN, CLOSE, CUT_BEFORE, CUT_AFTER = anchor_sql(12, 15), anchor_sql(4, 1), anchor_sql(1, 15), anchor_sql(3, 1)
YM = "strftime({}, '%Y_%m')"


def _plain(name, where="true", date="date", factor="1", src="eff0"):
    """Rows of a scenario without redistribution."""
    ms = ", ".join(f"{m} * {factor} AS {m}" for m in METRICS)
    return (
        f"SELECT '{name}' AS scenario, crab_year, region, cell_id, bia, CAST({date} AS DATE) AS date, false AS nobase, {ms} FROM {src} WHERE {where}"
    )


def _redist(name, src):
    """Rows of a scenario after redistribution of ``src`` (date, ym_old, to_shift, is_base, target, pct)."""
    head = f"SELECT '{name}' AS scenario, s.crab_year, s.region, s.cell_id, s.bia, s.date"
    ym = YM.format("s.date")
    return f"""
        {head}, false AS nobase, {', '.join('s.' + m for m in METRICS)} FROM ({src}) s WHERE NOT to_shift
        UNION ALL {head}, false, {', '.join(f'd.{m} * s.pings / b.bp' for m in METRICS)} FROM ({src}) s
            JOIN (SELECT region, ym_old, sum(pings) AS bp FROM ({src}) WHERE is_base GROUP BY 1, 2) b ON s.region = b.region AND s.ym_old = b.ym_old
            JOIN (SELECT target, {YM.format('date')} AS ym, {', '.join(f'sum({m} * pct) AS {m}' for m in METRICS)} FROM ({src}) WHERE to_shift GROUP BY 1, 2) d
            ON s.region = d.target AND s.ym_old = d.ym WHERE s.is_base
        UNION ALL {head}, true, {', '.join(f's.{m} * s.pct' for m in METRICS)} FROM ({src}) s WHERE s.to_shift AND
            (s.target, {ym}) NOT IN (SELECT (region, ym_old) FROM ({src}) WHERE is_base)"""


def _closure_src(closed, target, pct, base="true"):
    post = f"date >= {CLOSE}"
    return f"""SELECT crab_year, region, cell_id, bia, date, {YM.format('date')} AS ym_old, ({closed}) AND {post} AS to_shift,
        NOT (({closed}) AND {post}) AND {post} AND {base} AS is_base, {target} AS target, {pct}e0 AS pct, {M} FROM eff0"""


_LATE = f"greatest(date_diff('day', season_start, {OPEN}), 0)"
_DEPTH = "depth BETWEEN -100 AND -20"
OTHER = "CASE region WHEN 'CenCA' THEN 'NorCA' WHEN 'NorCA' THEN 'CenCA' END"

DELAYS = {
    "delay_remove": (
        Scenario("delay_remove", delay=(12, 15), delay_method="remove"),
        _plain("delay_remove", f"date >= {OPEN}"),
    ),
    "delay_depth": (
        Scenario("delay_depth", delay=(12, 15), delay_method="depth", delay_regions=("CenCA", "NorCA"), depth_shallow=-20.0, depth_deep=-100.0),
        _plain("delay_depth", f"region NOT IN ('CenCA', 'NorCA') OR date >= {OPEN} OR {_DEPTH}"),
    ),
    "delay_lag": (
        Scenario("delay_lag", delay=(12, 15), delay_method="lag"),
        _plain("delay_lag", date=f"date + CAST({_LATE} AS INT)"),
    ),
    "delay_pile": (
        Scenario("delay_pile", delay=(12, 15), delay_method="pile"),
        _plain("delay_pile", date=f"date + CASE WHEN date <= {OPEN} THEN CAST({_LATE} AS INT) ELSE 0 END"),
    ),
}

_PILE_DAYS = f"CASE WHEN region = 'CenCA' AND date <= {OPEN} THEN CAST({_LATE} AS INT) ELSE 0 END"
_PILE_SRC = f"""SELECT crab_year, region, cell_id, bia, date + days AS date, {YM.format('date')} AS ym_old, days > 0 AS to_shift,
    region = 'CenCA' AND date >= {OPEN} AS is_base, region AS target, 1e0 AS pct, {M} FROM (SELECT *, {_PILE_DAYS} AS days FROM eff0)"""
_AFTER_SRC = f"""SELECT crab_year, region, cell_id, bia, date, {YM.format('date')} AS ym_old, moved AS to_shift,
    NOT moved AND region <> 'CenCA' AND date >= {CUT_AFTER} AS is_base, CASE WHEN moved THEN 'NorCA' END AS target, 0.7e0 AS pct,
    {', '.join(f"{m} * CASE WHEN moved THEN 0.4e0 WHEN region = 'CenCA' AND date >= {CUT_AFTER} THEN 0.6e0 ELSE 1 END AS {m}" for m in METRICS)}
    FROM (SELECT *, false AS moved FROM eff0 UNION ALL SELECT *, true FROM eff0 WHERE region = 'CenCA' AND date >= {CUT_AFTER})"""

REDISTRIBUTIONS = {
    "delay_pile_temporal": (
        Scenario("delay_pile_temporal", delay=(12, 15), delay_method="pile", delay_regions=("CenCA",), delay_fidelity="temporal"),
        _redist("delay_pile_temporal", _PILE_SRC),
    ),
    "reduce_after_redist": (
        Scenario("reduce_after_redist", after=(3, 1), after_pct=40.0, after_regions=("CenCA",), after_redist=True, after_redist_pct=70.0),
        _redist("reduce_after_redist", _AFTER_SRC),
    ),
    "close_cen_temporal": (
        Scenario("close_cen_temporal", closure=(4, 1), closure_method="temporal", closure_regions=("CenCA",)),
        _redist("close_cen_temporal", _closure_src("region = 'CenCA'", OTHER, 1)),
    ),
    "close_bia_temporal": (
        Scenario("close_bia_temporal", closure=(4, 1), closure_method="temporal", closure_regions=("BIA",), closure_pct=80.0),
        _redist("close_bia_temporal", _closure_src("bia", "region", 0.8)),
    ),
    "close_depth_temporal": (
        Scenario("close_depth_temporal", closure=(4, 1), closure_method="depth+temporal", depth_shallow=-20.0, depth_deep=-100.0, closure_pct=90.0),
        _redist("close_depth_temporal", _closure_src(f"NOT ({_DEPTH})", "region", 0.9).replace("AS cell_id", "")),
    ),
}

SIMPLE = {
    "status_quo": (Scenario("status_quo"), _plain("status_quo")),
    "reduce_before": (
        Scenario("reduce_before", before=(1, 15), before_pct=50.0, before_regions=("CenCA", "OR")),
        _plain("reduce_before", factor=f"CASE WHEN region IN ('CenCA', 'OR') AND date < {CUT_BEFORE} THEN 0.5e0 ELSE 1 END"),
    ),
    "reduce_after": (
        Scenario("reduce_after", after=(3, 1), after_pct=40.0),
        _plain("reduce_after", factor=f"CASE WHEN date >= {CUT_AFTER} THEN 0.6e0 ELSE 1 END"),
    ),
    "close_remove": (
        Scenario("close_remove", closure=(4, 1), closure_method="remove"),
        _plain("close_remove", f"date < {CLOSE}"),
    ),
    "close_depth": (
        Scenario("close_depth", closure=(4, 1), closure_method="depth", closure_regions=("CenCA",), depth_shallow=-20.0, depth_deep=-100.0),
        _plain("close_depth", f"region <> 'CenCA' OR date < {CLOSE} OR {_DEPTH}"),
    ),
}

FLAGSHIP = ["status_quo", "reduce_before", "close_remove", "close_cen_temporal", "delay_remove"]
EVERY = {**SIMPLE, **DELAYS, **REDISTRIBUTIONS}


def _scenarios(names):
    return [EVERY[n][0] for n in names]


def _union(names):
    return " UNION ALL ".join(f"({EVERY[n][1]})" for n in names)


def _totals_sql(names):
    return f"SELECT scenario, crab_year, region, {YM.format('date')} AS year_month, nobase, {SUMS} FROM ({_union(names)}) GROUP BY ALL"


def _totals(t, names):
    out = sn.run_scenarios(t.effort, _scenarios(names))
    return out.groupBy("scenario", "crab_year", "region", "year_month", "nobase").agg(*[F.sum(m).alias(m) for m in METRICS])


@query("season_starts", "D6", sql="SELECT crab_year, region, first_date, backstop, greatest(first_date - 3, backstop) AS season_start FROM starts")
def season_starts(t):
    return sn.season_starts(t.effort).withColumn("season_start", F.greatest(F.date_sub("first_date", 3), F.col("backstop")))


@query(
    "early_data_piled", "D7", doubles=DBL, digits=3,
    sql=f"SELECT crab_year, region, greatest(date, greatest(first_date - 3, backstop)) AS date, {SUMS} FROM effort JOIN starts USING (crab_year, region) GROUP BY 1, 2, 3",
)
def early_data_piled(t):
    out = sn.run_scenarios(t.effort, [Scenario("pile", early_method="pile")])
    return out.groupBy("crab_year", "region", "date").agg(*[F.sum(m).alias(m) for m in METRICS])


@query(
    "season_end_flags", "D8",
    sql="""SELECT crab_year, region, max(date) AS season_end, make_date(CAST(substr(crab_year, 6, 4) AS INT), CASE region WHEN 'CenCA' THEN 6 ELSE 7 END, CASE region WHEN 'CenCA' THEN 30 ELSE 15 END) AS region_end,
        count_if(date > make_date(CAST(substr(crab_year, 6, 4) AS INT), CASE region WHEN 'CenCA' THEN 6 ELSE 7 END, CASE region WHEN 'CenCA' THEN 30 ELSE 15 END)) AS n_late FROM effort GROUP BY 1, 2""",
)
def season_end_flags(t):
    e = t.effort.join(sn.season_ends(t.effort), ["crab_year", "region"])
    return sn.end_flags(e).groupBy("crab_year", "region", "season_end", "region_end").agg(F.count_if("past_region_end").alias("n_late"))


@query("percent_reductions", "D9 D11", doubles=DBL, digits=3, sql=_totals_sql(["status_quo", "reduce_before", "reduce_after"]))
def percent_reductions(t):
    return _totals(t, ["status_quo", "reduce_before", "reduce_after"])


@query("delayed_openings", "D10", doubles=DBL, digits=3, sql=_totals_sql(list(DELAYS)))
def delayed_openings(t):
    return _totals(t, list(DELAYS))


@query("early_closures", "D12", doubles=DBL, digits=3, sql=_totals_sql(["close_remove", "close_depth"]))
def early_closures(t):
    return _totals(t, ["close_remove", "close_depth"])


@query("temporal_redistribution", "D14", doubles=DBL, digits=3, sql=_totals_sql(["close_cen_temporal", "close_bia_temporal", "close_depth_temporal"]))
def temporal_redistribution(t):
    return _totals(t, ["close_cen_temporal", "close_bia_temporal", "close_depth_temporal"])


@query("delay_redistribution", "D10 D14", doubles=DBL, digits=3, sql=_totals_sql(["delay_pile_temporal"]))
def delay_redistribution(t):
    return _totals(t, ["delay_pile_temporal"])


@query("reduction_redistribution", "D11 D14", doubles=DBL, digits=3, sql=_totals_sql(["reduce_after_redist"]))
def reduction_redistribution(t):
    return _totals(t, ["reduce_after_redist"])


@query("scenario_sweep", "D13 D15", doubles=DBL, digits=3, sql=_totals_sql(list(EVERY)))
def scenario_sweep(t):
    return _totals(t, list(EVERY))


@query("scenario_parameter_table", "D15", doubles=DBL, digits=3, sql=_totals_sql(list(EVERY)))
def scenario_parameter_table(t):
    """The same sweep from a parameter table with absent values."""
    table = sn.scenario_table(t.spark, _scenarios(list(EVERY)))
    out = sn.run_scenarios(t.effort, sn.scenarios_from_table(table))
    return out.groupBy("scenario", "crab_year", "region", "year_month", "nobase").agg(*[F.sum(m).alias(m) for m in METRICS])


_REGION_END = "make_date(CAST(substr(crab_year, 6, 4) AS INT), CASE region WHEN 'CenCA' THEN 6 ELSE 7 END, CASE region WHEN 'CenCA' THEN 30 ELSE 15 END)"


@query(
    "out_of_season_report", "D59", doubles="pct_pings_late",
    sql=f"""SELECT scenario, count(*) AS n_rows, count_if(late) AS n_late, 100 * coalesce(sum(pings) FILTER (late), 0) / sum(pings) AS pct_pings_late FROM (
        SELECT scenario, cell_id, date, date > {_REGION_END} AS late, sum(pings) AS pings FROM ({_union(['status_quo', *DELAYS])}) GROUP BY ALL) GROUP BY 1""",
)
def out_of_season_report(t):
    return sn.season_drop_report(sn.run_scenarios(t.effort, _scenarios(["status_quo", *DELAYS]), compact=True))


def _scenario_risk(t, names):
    base = sn.prepare_effort(t.effort)
    swept = sn.run_scenarios(base, _scenarios(names), prepared=True).where("NOT nobase AND NOT past_region_end")
    monthly = base.groupBy("cell_id", F.trunc("date", "month")).agg(F.sum("pings").alias("pings"))
    # Two numbers, looked up once instead of by a subquery for each use.
    lo, hi = monthly.agg(F.min("pings"), F.max("pings")).first()
    area = t.grid.select("cell_id", "area")
    return rk.risk(swept, t.species, area, "pings", lo, hi, group=["scenario"])


def _risk_sql(names):
    return f"""SELECT x.*, area, occ, dens, n_occ, n_dens, pings * dens AS risk_hump, pings * occ AS risk_blue,
        (pings - lo) / (hi - lo) * n_dens AS n_risk_hump, (pings - lo) / (hi - lo) * n_occ AS n_risk_blue FROM (
        SELECT scenario, region, cell_id, bia, {YM.format('date')} AS year_month, {SUMS} FROM ({_union(names)}) WHERE NOT nobase AND date <= {_REGION_END} GROUP BY ALL) x
        JOIN (SELECT cell_id AS gid, area FROM grid) ON gid = cell_id
        LEFT JOIN (SELECT cell_id AS sid, year_month AS sym, occ, dens, n_occ, n_dens FROM species) ON sid = cell_id AND sym = year_month,
        (SELECT min(p) AS lo, max(p) AS hi FROM (SELECT sum(pings) AS p FROM effort GROUP BY cell_id, year_month))"""


_RISKS = rk.RISKS
_ALL = [*METRICS, *_RISKS]
_CY_OF_YM = crab_year_sql("strptime(year_month || '_01', '%Y_%m_%d')")


def _summary_sql(names):
    sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in _ALL)
    return f"SELECT *, {_CY_OF_YM} AS crab_year FROM (SELECT scenario, year_month, region, {sums} FROM ({_risk_sql(names)}) GROUP BY 1, 2, 3)"


@query(
    "scenario_risk_by_region", "D16 D17", doubles=DBL + " risk_hump:6 risk_blue:6 n_risk_hump:8 n_risk_blue:8",
    sql=_summary_sql(["status_quo", "close_remove", "close_cen_temporal"]),
)
def scenario_risk_by_region(t):
    return rk.risk_summary(_scenario_risk(t, ["status_quo", "close_remove", "close_cen_temporal"]), "region", ["scenario"])


def _annual_sql(names):
    v = ["lbs", "rev", "pings", "vessel_share", *_RISKS]
    return f"""SELECT *, 0.5e0 * risk_hump + 0.5e0 * risk_blue AS risk_both, 0.5e0 * n_risk_hump + 0.5e0 * n_risk_blue AS n_risk_both FROM (
        SELECT scenario, crab_year, {', '.join(f'sum({c}) AS {c}' for c in v)} FROM ({_summary_sql(names)}) GROUP BY 1, 2)"""


_R6 = ["risk_hump", "risk_blue", "risk_both", "n_risk_hump", "n_risk_blue", "n_risk_both"]


def _tradeoff_sql(names):
    b = lambda c: f"max({c}) FILTER (scenario = 'status_quo') OVER (PARTITION BY crab_year)"
    rel = ", ".join(f"100 * (1 - {c} / {b(c)}) AS rel_{c}" for c in [*_R6, "pings"])
    kept = ", ".join(f"100 * {c} / {b(c)} AS rel_{c}" for c in ["rev", "lbs"])
    return f"SELECT *, {rel}, {kept} FROM ({_annual_sql(names)})"


def _annual(t, names):
    return tr.annual_totals(rk.risk_summary(_scenario_risk(t, names), "region", ["scenario"]))


_REL = [f"rel_{c}" for c in [*_R6, "pings", "rev", "lbs"]]


@query(
    "scenario_tradeoff", "D19", doubles="lbs:5 rev:3 pings:6 vessel_share:8 " + " ".join([f"{c}:4" for c in _R6] + [f"{c}:7" for c in _REL]),
    sql=_tradeoff_sql(FLAGSHIP),
)
def scenario_tradeoff(t):
    return tr.tradeoff(_annual(t, FLAGSHIP), "status_quo")


def _bc_sql(names):
    cost = "CASE WHEN rel_rev >= 99 THEN 1 ELSE 100 - rel_rev END"
    bc = lambda c, n: f"CASE WHEN {c} >= 0 THEN {c} / ({cost}) ELSE 0 END AS {n}"
    return f"SELECT *, {bc('rel_n_risk_hump', 'bc_hump')}, {bc('rel_n_risk_blue', 'bc_blue')} FROM ({_tradeoff_sql(names)})"


_RANK = {
    "rank_hump": "rel_n_risk_hump", "rank_blue": "rel_n_risk_blue", "rank_both": "rel_n_risk_both",
    "rank_rev": "rel_rev", "rank_lbs": "rel_lbs", "rank_bc_hump": "bc_hump", "rank_bc_blue": "bc_blue",
}


def _snapped(df):
    """Measures rounded before ranking, so that equal results tie instead of differing by summation order."""
    cols = [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _snapped_sql(body):
    cols = ["lbs", "rev", "pings", "vessel_share", *_R6, *_REL, "bc_hump", "bc_blue"]
    return f"SELECT scenario, crab_year, {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM ({body})"


@query(
    "scenario_ranks", "D20 W1", doubles="bc_hump bc_blue", digits=4,
    sql="SELECT scenario, crab_year, bc_hump, bc_blue, "
    + ", ".join(f"row_number() OVER (PARTITION BY crab_year ORDER BY {c}, scenario) AS {n}" for n, c in _RANK.items())
    + f" FROM ({_snapped_sql(_bc_sql(FLAGSHIP))})",
)
def scenario_ranks(t):
    d = _snapped(tr.benefit_cost(tr.tradeoff(_annual(t, FLAGSHIP), "status_quo")))
    return tr.rank_scenarios(d).select("scenario", "crab_year", "bc_hump", "bc_blue", *_RANK)


_PERIOD = "CASE WHEN CAST(substr(crab_year, 6, 4) AS INT) < 1998 THEN 'pre' ELSE 'post' END"


def _period():
    return F.when(F.substring("crab_year", 6, 4).cast("int") < 1998, "pre").otherwise("post")


@query(
    "scenario_period_ranks", "D20 W2", doubles="rel_n_risk_hump rel_rev bc_hump", digits=4,
    sql="SELECT period, scenario, rel_n_risk_hump, rel_rev, bc_hump, "
    + ", ".join(f"row_number() OVER (PARTITION BY period ORDER BY {c}, scenario) AS {n}" for n, c in _RANK.items())
    + ", row_number() OVER (PARTITION BY period ORDER BY n_risk_hump DESC, n_risk_blue DESC, n_risk_both DESC, rev DESC, lbs DESC, scenario) AS scenario_rank FROM ("
    + f"SELECT {_PERIOD} AS period, scenario, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ["n_risk_hump", "n_risk_blue", "n_risk_both", "rev", "lbs", "rel_n_risk_hump", "rel_n_risk_blue", "rel_n_risk_both", "rel_rev", "rel_lbs", "bc_hump", "bc_blue"])
    + f" FROM ({_snapped_sql(_bc_sql(FLAGSHIP))}) GROUP BY 1, 2)",
)
def scenario_period_ranks(t):
    d = _snapped(tr.benefit_cost(tr.tradeoff(_annual(t, FLAGSHIP), "status_quo")))
    return tr.rank_by_period(d, _period(), 4).select("period", "scenario", "rel_n_risk_hump", "rel_rev", "bc_hump", *_RANK, "scenario_rank")


_CE = ["rel_n_risk_hump", "rel_n_risk_blue", "cost", "cost_per_hump", "cost_per_blue"]
_QS = [0.025, 0.25, 0.5, 0.75, 0.975]


def _ce_sql():
    inner = f"""SELECT {_PERIOD} AS period, scenario, rel_n_risk_hump, rel_n_risk_blue, 100 - rel_rev AS cost, (100 - rel_rev) / nullif(rel_n_risk_hump, 0) AS cost_per_hump,
        (100 - rel_rev) / nullif(rel_n_risk_blue, 0) AS cost_per_blue FROM ({_snapped_sql(_bc_sql(FLAGSHIP))}) WHERE scenario <> 'status_quo'"""
    return " UNION ALL ".join(
        f"SELECT period, scenario, {q}e0 AS quantile, {', '.join(f'quantile_cont({c}, {q}) AS {c}' for c in _CE)} FROM ({inner}) GROUP BY 1, 2" for q in _QS
    )


@query("cost_effectiveness", "D21", doubles=" ".join(_CE), digits=9, sql=_ce_sql())
def cost_effectiveness(t):
    d = _snapped(tr.benefit_cost(tr.tradeoff(_annual(t, FLAGSHIP), "status_quo")))
    return tr.cost_effectiveness(d, _period(), "status_quo", _QS)


@query(
    "cost_effectiveness_ranks", "D21 W13", doubles="cost_per_hump",
    sql=f"""SELECT *, min(scenario_rank) OVER (PARTITION BY scenario) AS scenario_min_rank FROM (SELECT period, scenario, cost_per_hump,
        row_number() OVER (ORDER BY cost_per_hump NULLS LAST, cost_per_blue NULLS LAST, scenario, period) AS scenario_rank FROM ({_ce_sql()}) WHERE quantile = 0.5)""",
)
def cost_effectiveness_ranks(t):
    d = _snapped(tr.benefit_cost(tr.tradeoff(_annual(t, FLAGSHIP), "status_quo")))
    return tr.median_rank(tr.cost_effectiveness(d, _period(), "status_quo", _QS)).select(
        "period", "scenario", "cost_per_hump", "scenario_rank", "scenario_min_rank"
    )


@query(
    "annual_distribution", "D23", doubles="total_rev mean_rev median_rev max_rev total_risk_hump mean_risk_hump median_risk_hump max_risk_hump", digits=3,
    sql="SELECT crab_year, "
    + ", ".join(f"{f}({c}) AS {n}_{c}" for c in ("rev", "risk_hump") for n, f in (("total", "sum"), ("mean", "avg"), ("median", "median"), ("max", "max")))
    + f" FROM (SELECT crab_year, year_month, sum(rev) AS rev, sum(risk_hump) AS risk_hump FROM ({_summary_sql(['status_quo'])}) GROUP BY 1, 2) GROUP BY 1",
)
def annual_distribution(t):
    s = rk.risk_summary(_scenario_risk(t, ["status_quo"]), "region", ["scenario"])
    return tr.annual_distribution(s, ["rev", "risk_hump"])

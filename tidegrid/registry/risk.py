"""Risk series, baselines, look-backs, overlap and hot spots over the given tables."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.joins import full_join
from ..operators.skew import exact_quantiles
from ..operators.windows import lag_difference
from ..plans import risk as rk
from ..plans import tradeoff as tr
from .bindings import CTES, crab_year_sql
from .core import query

_YMD = "strptime(year_month || '_01', '%Y_%m_%d')"
CY = crab_year_sql(_YMD)
MON = "CAST(substr(year_month, 6, 2) AS INT)"


def _ym_date(c="year_month"):
    return F.make_date(F.substring(c, 1, 4).cast("int"), F.substring(c, 6, 2).cast("int"), F.lit(1))


def _cm(t):
    """Cell-months with crab year and calendar month."""
    return t.cell_month.withColumns({"crab_year": cal.crab_year(_ym_date()), "month": F.substring("year_month", 6, 2).cast("int")})


CTES["cm"] = f"SELECT *, {CY} AS crab_year, {MON} AS month FROM cell_month"


@query(
    "risk_density_in_and_out_of_areas", "D16 D17", doubles="risk_hump risk_blue n_risk_hump", digits=6,
    sql=f"""SELECT year_month, bia, coalesce(sum(p * dens / area), 0) AS risk_hump, coalesce(sum(p * occ / area), 0) AS risk_blue, coalesce(sum((p - lo) / (hi - lo) * n_dens / area), 0) AS n_risk_hump
        FROM (SELECT cell_id, year_month, bia, area, CAST(sum(pings) AS DOUBLE) AS p FROM effort WHERE year_month BETWEEN '1995_11' AND '1999_10' GROUP BY ALL) e LEFT JOIN species USING (cell_id, year_month),
        (SELECT min(p) AS lo, max(p) AS hi FROM (SELECT sum(pings) AS p FROM effort GROUP BY cell_id, year_month)) GROUP BY 1, 2""",
)
def risk_density_in_and_out_of_areas(t):
    m = t.effort.groupBy("cell_id", "year_month").agg(F.sum("pings").alias("pings"))
    one = m.agg(F.struct(F.min("pings").alias("lo"), F.max("pings").alias("hi")).alias("r")).scalar()
    r = rk.risk(t.effort.drop("area"), t.species, t.grid.select("cell_id", "area"), "pings", one["lo"], one["hi"], "dens", months=("1995_11", "1999_10"))
    return rk.risk_summary(r, "bia").select("year_month", "bia", "risk_hump", "risk_blue", "n_risk_hump")


@query(
    "self_normalised_risk", "D18", doubles="n_risk_hump n_risk_blue", digits=8,
    sql="""SELECT cell_id, year_month, (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER ()) * (dens - min(dens) OVER ()) / (max(dens) OVER () - min(dens) OVER ()) AS n_risk_hump,
        (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER ()) * (occ - min(occ) OVER ()) / (max(occ) OVER () - min(occ) OVER ()) AS n_risk_blue
        FROM (SELECT cell_id, year_month, sum(lbs) AS e FROM effort GROUP BY 1, 2) LEFT JOIN species USING (cell_id, year_month)""",
)
def self_normalised_risk(t):
    return rk.risk_self_normalised(t.effort, t.species, "lbs").select("cell_id", "year_month", "n_risk_hump", "n_risk_blue")


_QS = {"q50": 0.5, "q90": 0.9}


@query(
    "period_change_by_cell", "D22", doubles="pings dens diff_pings diff_dens", digits=8,
    sql="""SELECT *, pings - lag(pings, 1, 0) OVER w AS diff_pings, dens - lag(dens, 1, 0) OVER w AS diff_dens FROM (SELECT cell_id, CASE WHEN crab_year < '1997_1998' THEN 'a' WHEN crab_year < '1999_2000' THEN 'b' ELSE 'c' END AS period,
        median(pings) AS pings, median(dens) AS dens FROM cm GROUP BY 1, 2) WINDOW w AS (PARTITION BY cell_id ORDER BY period)""",
)
def period_change_by_cell(t):
    cy = F.col("crab_year")
    d = _cm(t).withColumn("period", F.when(cy < "1997_1998", "a").when(cy < "1999_2000", "b").otherwise("c"))
    keys = ["cell_id", "period"]
    m = exact_quantiles(d, keys, "pings", {"pings": 0.5}).join(exact_quantiles(d, keys, "dens", {"dens": 0.5}), keys)
    return lag_difference(m, ["cell_id"], ["period"], {"diff_pings": "pings", "diff_dens": "dens"})


@query(
    "monthly_prediction_means", "D24 R1", doubles="mean se", digits=8,
    sql="""SELECT cell_id, date_trunc('month', d)::DATE AS interval, avg(x) AS mean, count(x) AS n_values, CASE WHEN count(x) > 0 THEN sqrt(var_pop(x) * count(x) / count(*)) END AS se FROM (
        SELECT l_partkey % 400 AS cell_id, CAST(l_shipdate AS DATE) AS d, nullif(l_tax, 0.03) AS x FROM lineitem) GROUP BY 1, 2""",
)
def monthly_prediction_means(t):
    li = t.read("lineitem").select((F.col("l_partkey") % 400).alias("cell_id"), F.col("l_shipdate").cast("date").alias("d"), F.nullif(F.col("l_tax"), F.lit(0.03)).alias("x"))
    return rk.aggregate_predictions(li, ["cell_id"], "d", "x", F.trunc("d", "month").cast("date"))


@query(
    "n_day_prediction_means", "D24", doubles="mean se", digits=8,
    sql="""SELECT sx, DATE '2024-01-03' + CAST(floor(date_diff('day', DATE '2024-01-03', day) / 14) * 14 AS INT) AS interval, avg(value) AS mean, count(value) AS n_values, sqrt(var_pop(value)) AS se
        FROM ocean WHERE day >= DATE '2024-01-03' GROUP BY 1, 2""",
)
def n_day_prediction_means(t):
    return rk.aggregate_predictions(t.ocean, ["sx"], "day", "value", rk.n_day_interval("day", "2024-01-03", 14))


_BOUNDS = ["1996-01-01", "1996-05-01", "1997-02-15", "2050-01-01", "2051-01-01"]


@query(
    "custom_prediction_means", "D24", doubles="mean se", digits=8,
    sql="""SELECT cell_id, CASE WHEN d < DATE '1996-05-01' THEN DATE '1996-01-01' WHEN d < DATE '1997-02-15' THEN DATE '1996-05-01' ELSE DATE '1997-02-15' END AS interval,
        avg(x) AS mean, count(x) AS n_values, sqrt(var_pop(x)) AS se FROM (SELECT l_partkey % 400 AS cell_id, CAST(l_shipdate AS DATE) AS d, l_tax AS x FROM lineitem) WHERE d >= DATE '1996-01-01' GROUP BY 1, 2""",
)
def custom_prediction_means(t):
    li = t.read("lineitem").select((F.col("l_partkey") % 400).alias("cell_id"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_tax").alias("x"))
    return rk.aggregate_predictions(li, ["cell_id"], "d", "x", rk.custom_interval("d", _BOUNDS))


@query("empty_prediction_intervals", "D24", sql="SELECT DATE '2050-01-01' AS interval WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_shipdate >= DATE '2050-01-01')")
def empty_prediction_intervals(t):
    return rk.empty_intervals(t.read("lineitem").withColumn("d", F.col("l_shipdate").cast("date")), "d", _BOUNDS)


_RS = "sum_dens sum_pings sum_risk area_sum area_dens area_risk dens_per_area pings_per_area risk_per_area dens_per_seen risk_per_seen"


@query(
    "region_month_series", "D25 A22", doubles=_RS, digits=7,
    sql="""SELECT *, sum_dens / area_sum AS dens_per_area, sum_pings / area_sum AS pings_per_area, sum_risk / area_sum AS risk_per_area, sum_dens / area_dens AS dens_per_seen, sum_risk / area_risk AS risk_per_seen FROM (
        SELECT region, year_month, sum(dens) AS sum_dens, CASE WHEN count(p) = count(*) THEN sum(p) END AS sum_pings, CASE WHEN count(r) = count(*) THEN sum(r) END AS sum_risk, sum(area) AS area_sum,
        sum(area) AS area_dens, sum(area) FILTER (r IS NOT NULL) AS area_risk FROM (SELECT *, CASE WHEN NOT late THEN pings END AS p, CASE WHEN NOT late THEN risk END AS r FROM (
        SELECT *, region IN ('OR', 'WA') AND year_month >= '2000_08' AS late FROM cell_month)) GROUP BY 1, 2)""",
)
def region_month_series(t):
    return rk.region_series(t.cell_month, F.col("region").isin("OR", "WA") & (F.col("year_month") >= "2000_08"))


@query(
    "baseline_substituted_risk", "D26 J4", doubles="risk risk_base_species risk_base_fishing risk_base_both", digits=7,
    sql="""SELECT region, year_month, sum(risk) AS risk, coalesce(sum(db * pings), 0) AS risk_base_species, coalesce(sum(dens * pb), 0) AS risk_base_fishing, coalesce(sum(db * pb), 0) AS risk_base_both FROM cm
        LEFT JOIN (SELECT cell_id, month, avg(dens) AS db, avg(pings) AS pb FROM cm WHERE year_month < '1997_11' GROUP BY 1, 2) USING (cell_id, month) GROUP BY 1, 2""",
)
def baseline_substituted_risk(t):
    b = rk.baseline_risk(t.cell_month, F.col("year_month") < "1997_11")
    from ..functions.nulls import sum_or_zero

    return b.groupBy("region", "year_month").agg(*[sum_or_zero(c).alias(c) for c in ("risk", "risk_base_species", "risk_base_fishing", "risk_base_both")])


@query(
    "season_risk_without_months", "D27", doubles="risk_all risk_kept risk_ratio risk_diff", digits=7,
    sql="""SELECT *, risk_kept / nullif(risk_all, 0) AS risk_ratio, risk_kept - risk_all AS risk_diff FROM (SELECT region, crab_year, sum(risk) AS risk_all,
        coalesce(sum(risk) FILTER (month NOT IN (4, 5, 6)), 0) AS risk_kept FROM cm GROUP BY 1, 2)""",
)
def season_risk_without_months(t):
    return rk.season_risk_without(_cm(t), [4, 5, 6])


@query(
    "displaced_effort_risk", "D28 W7", doubles="risk pings area risk_per_area", digits=6,
    sql="""WITH tot AS (SELECT region, crab_year, coalesce(sum(pings) FILTER (month IN (4, 5)), 0) AS moved, coalesce(sum(pings) FILTER (month = 1), 0) AS to_sum, count_if(month = 1) AS to_n FROM cm GROUP BY 1, 2),
        m AS (SELECT region, crab_year, cell_id, area, dens, pings + CASE WHEN month = 1 THEN moved * CASE WHEN to_sum > 0 THEN pings / to_sum ELSE 1 / to_n END ELSE 0 END AS pings FROM cm JOIN tot USING (region, crab_year) WHERE month NOT IN (4, 5))
        SELECT region, crab_year, risk, pings, area, risk / area AS risk_per_area FROM (SELECT region, crab_year, sum(dens * pings) AS risk, sum(pings) AS pings FROM m GROUP BY 1, 2)
        JOIN (SELECT region, crab_year, sum(area) AS area FROM (SELECT DISTINCT region, crab_year, cell_id, area FROM m) GROUP BY 1, 2) USING (region, crab_year)""",
)
def displaced_effort_risk(t):
    return rk.season_risk(rk.displace(_cm(t), [4, 5], 1))


@query(
    "event_lookback_risk", "D29 J10", doubles="risk_max risk_sum risk_min", digits=8,
    sql="""SELECT case_id, region, w AS window_months, max(risk) AS risk_max, coalesce(sum(risk), 0) AS risk_sum, min(risk) AS risk_min, arg_max(m, (risk, m)) FILTER (risk IS NOT NULL) AS month_of_max FROM (
        SELECT c.case_id, c.region, w, s.m, s.risk FROM cases c, range(7) r(w) LEFT JOIN (SELECT region, CAST(strptime(year_month || '_01', '%Y_%m_%d') AS DATE) AS m, round(sum(risk), 8) AS risk FROM cell_month GROUP BY 1, 2) s
        ON s.region = c.region AND s.m BETWEEN CAST(c.month_start - to_months(CAST(w AS INT)) AS DATE) AND c.month_start) GROUP BY 1, 2, 3""",
)
def event_lookback_risk(t):
    s = t.cell_month.groupBy("region", _ym_date().alias("month_start")).agg(F.round(F.sum("risk"), 8).alias("risk"))
    return rk.lookback_risk(t.events, s, "case_id", 6)


@query(
    "events_against_all_values", "D30", doubles="mean_risk", digits=7,
    sql="""WITH s AS (SELECT region, year_month, sum(risk) AS risk FROM cell_month GROUP BY 1, 2) SELECT tag, region, count(*) AS n, avg(risk) AS mean_risk FROM (
        SELECT 'All' AS tag, region, risk FROM s UNION ALL SELECT 'Events', region, risk FROM cases LEFT JOIN (SELECT region, risk, year_month AS sym FROM s) USING (region) WHERE sym = strftime(month_start, '%Y_%m')) GROUP BY 1, 2""",
)
def events_against_all_values(t):
    s = t.cell_month.groupBy("region", "year_month").agg(F.sum("risk").alias("risk"))
    linked = t.events.select("case_id", "region", cal.year_month("month_start").alias("year_month")).join(s, ["region", "year_month"])
    return rk.tag_and_stack(s, linked).groupBy("tag", "region").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk"))


@query(
    "overlap_risk_rules", "D44", doubles="risk", digits=11,
    sql="""SELECT coalesce(e.cell_id, s.cell_id) AS cell_id, coalesce(e.year_month, s.year_month) AS year_month, CASE WHEN p IS NULL OR p = 0 THEN 0 WHEN dens IS NULL THEN NULL ELSE p * dens END AS risk FROM (
        SELECT cell_id, year_month, sum(pings) AS p FROM effort GROUP BY 1, 2) e FULL JOIN species s ON e.cell_id = s.cell_id AND e.year_month = s.year_month""",
)
def overlap_risk_rules(t):
    e = t.effort.groupBy("cell_id", "year_month").agg(F.sum("pings").alias("p"))
    j = full_join(e, t.species.select("cell_id", "year_month", "dens"), ["cell_id", "year_month"])
    return j.select("cell_id", "year_month", rk.overlap_risk(j, "p", "dens").alias("risk"))


def _seasonal(t):
    c = _cm(t).withColumnRenamed("crab_year", "season")
    return (
        c.where("pings > 0").select("cell_id", "month", "season", "pings"),
        c.select("cell_id", "month", "season", "dens"),
    )


_CF = """SELECT season, sum(r) AS risk, count(r) AS n_known FROM (SELECT f.season, CASE WHEN {2} IS NULL OR {2} = 0 THEN 0 WHEN {3} IS NULL THEN NULL ELSE {2} * {3} END AS r
    FROM (SELECT cell_id, month, crab_year AS season, {0} FROM cm {4}) f LEFT JOIN (SELECT cell_id, month, {1} FROM cm WHERE crab_year = '1997_1998' {5}) x USING (cell_id, month)) GROUP BY 1"""


@query("species_year_held_constant", "D45", doubles="risk", digits=6, sql=_CF.format("pings", "dens", "pings", "dens", "WHERE pings > 0", ""))
def species_year_held_constant(t):
    f, s = _seasonal(t)
    return rk.counterfactual_risk(f, s, "1997_1998").groupBy("season").agg(F.sum("risk").alias("risk"), F.count("risk").alias("n_known"))


@query("fishing_year_held_constant", "D45", doubles="risk", digits=6, sql=_CF.format("dens", "pings", "pings", "dens", "", "AND pings > 0"))
def fishing_year_held_constant(t):
    f, s = _seasonal(t)
    return rk.counterfactual_risk(f, s, "1997_1998", "fishing").groupBy("season").agg(F.sum("risk").alias("risk"), F.count("risk").alias("n_known"))


@query(
    "effort_inside_hotspots", "D43 W15", doubles="inside outside",
    sql="""SELECT region, sum(pings) FILTER (hot) AS inside, coalesce(sum(pings) FILTER (NOT hot), 0) AS outside, count_if(hot) AS n_inside FROM (SELECT region, pings, dens >= cut AS hot FROM cm
        JOIN (SELECT region, crab_year, quantile_cont(dens, 0.75) AS cut FROM cm GROUP BY 1, 2) USING (region, crab_year)) GROUP BY 1""",
)
def effort_inside_hotspots(t):
    c = _cm(t)
    hot = rk.hotspots(c, ["region", "crab_year"], "dens", 0.75)
    return rk.effort_in_hotspots(hot, c, ["cell_id", "year_month"], ["region"], "pings")


@query(
    "risk_by_habitat_class", "D60", doubles="risk", digits=6,
    sql="""SELECT crab_year, habitat_class, sum(risk) AS risk, count(DISTINCT cell_id) FILTER (pings > 0) AS n_fished FROM (SELECT *, CASE WHEN dens >= c2 THEN 'top' WHEN dens >= c1 THEN 'high' WHEN dens >= c0 THEN 'mid' ELSE 'below' END AS habitat_class FROM cm
        JOIN (SELECT crab_year, quantile_cont(dens, 0.5) AS c0, quantile_cont(dens, 0.75) AS c1, quantile_cont(dens, 0.9) AS c2 FROM cm GROUP BY 1) USING (crab_year)) GROUP BY 1, 2""",
)
def risk_by_habitat_class(t):
    h = rk.habitat_class(_cm(t), ["crab_year"], "dens", {"mid": 0.5, "high": 0.75, "top": 0.9})
    return h.groupBy("crab_year", "habitat_class").agg(
        F.sum("risk").alias("risk"), F.countDistinct(F.when(F.col("pings") > 0, F.col("cell_id"))).alias("n_fished")
    )


@query(
    "pre_post_change", "D49", doubles="pre_mean year_value pct_change", digits=6,
    sql="""SELECT *, 100 * (year_value - pre_mean) / pre_mean AS pct_change FROM (SELECT region, avg(lbs) FILTER (crab_year < '1998_1999') AS pre_mean, avg(lbs) FILTER (crab_year = '1999_2000') AS year_value
        FROM (SELECT region, crab_year, sum(lbs) AS lbs FROM effort GROUP BY 1, 2) GROUP BY 1)""",
)
def pre_post_change(t):
    g = t.effort.groupBy("region", "crab_year").agg(F.sum("lbs").alias("lbs"))
    return tr.pre_post_change(g, ["region"], "lbs", F.col("crab_year") < "1998_1999", F.col("crab_year") == "1999_2000")


@query(
    "coverage_report", "D58 U6",
    sql="""SELECT count_if(a IS NOT NULL AND b IS NOT NULL) AS n_both, count_if(b IS NULL) AS n_only_first, count_if(a IS NULL) AS n_only_second, count_if(v = 0) AS n_without_value FROM (
        SELECT DISTINCT o_custkey AS a FROM orders WHERE o_custkey % 3 <> 0) x FULL JOIN (SELECT c_custkey AS b, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS v FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1) y ON a = b""",
)
def coverage_report(t):
    a = t.read("orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("k"))
    b = t.read("customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, 1).alias("v"))
    return rk.coverage_report(a, b, "k", "v")

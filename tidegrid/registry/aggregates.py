"""Grouped aggregates over the given tables."""

import math

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import nulls as nl
from ..operators import aggs as ag
from ..plans.effort import METRICS
from .core import query


@query(
    "metric_sums", "A1 A2", doubles="lbs rev vessel_share", digits=4,
    sql="""SELECT crab_year, region, sum(lbs) AS lbs, sum(rev) AS rev, CAST(sum(pings) AS BIGINT) AS pings, sum(vessel_share) AS vessel_share,
        CAST(sum(vessels) AS BIGINT) AS vessels FROM effort GROUP BY 1, 2""",
)
def metric_sums(t):
    g = ag.sum_metrics(t.effort, ["crab_year", "region"], METRICS)
    return g.withColumns({c: F.col(c).cast("long") for c in ("pings", "vessels")})


@query(
    "distinct_counts", "A3",
    sql="""SELECT l_linenumber, count(*) AS n, count(DISTINCT l_suppkey) AS n_supp,
        count(DISTINCT nullif(l_tax, 0)) + max((nullif(l_tax, 0) IS NULL)::INT) AS n_tax_or_missing FROM lineitem GROUP BY 1""",
)
def distinct_counts(t):
    li = t.read("lineitem").withColumn("tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    return li.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("n_supp"), nl.n_distinct_with_null("tax").alias("n_tax_or_missing")
    )


@query(
    "summary_statistics", "A4 G21", doubles="mean sd min max median",
    sql="""SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS min,
        max(l_extendedprice) AS max, median(l_extendedprice) AS median FROM lineitem GROUP BY 1, 2""", digits=4,
)
def summary_statistics(t):
    return ag.summary_stats(t.read("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


_Q = [0.025, 0.25, 0.5, 0.75, 0.975]
_QN = [f"q{round(q * 1000):04d}" for q in _Q]


@query(
    "quantiles_long", "A5", doubles="value",
    sql="SELECT region, unnest(" + str(_QN) + ") AS quantile, unnest(quantile_cont(rev, " + str(_Q) + ")) AS value FROM effort GROUP BY region",
)
def quantiles_long(t):
    return ag.quantiles_long(t.effort, ["region"], "rev", _Q)


@query(
    "quantiles_wide", "A6", doubles=" ".join(_QN), digits=9,
    sql="SELECT region, year_month, " + ", ".join(f"quantile_cont(dens, {q}) AS {n}" for q, n in zip(_Q, _QN)) + " FROM cell_month GROUP BY 1, 2",
)
def quantiles_wide(t):
    return ag.quantiles_wide(t.cell_month, ["region", "year_month"], "dens", _Q)


@query(
    "conditional_aggregates", "A7 D48", doubles="area_seen share_late",
    sql="""SELECT region, sum(area) FILTER (dens > 0.0412) AS area_seen, sum(pings) FILTER (substr(year_month, 6, 2) >= '06') / sum(pings) AS share_late FROM cell_month GROUP BY 1""",
)
def conditional_aggregates(t):
    late = F.substring("year_month", 6, 2) >= "06"
    return t.cell_month.groupBy("region").agg(
        F.sum(F.when(F.col("dens") > 0.0412, F.col("area"))).alias("area_seen"),
        (F.sum(F.when(late, F.col("pings"))) / F.sum("pings")).alias("share_late"),
    )


@query(
    "area_of_distinct_cells", "A8 D57", doubles="area_fished",
    sql="SELECT crab_year, region, sum(area) AS area_fished, count(*) AS n_cell_id FROM (SELECT DISTINCT crab_year, region, cell_id, area FROM effort) GROUP BY 1, 2",
)
def area_of_distinct_cells(t):
    return ag.sum_distinct_by(t.effort, ["crab_year", "region"], "cell_id", "area", "area_fished")


@query(
    "mean_per_set_summed", "A9", doubles="traps",
    sql="""SELECT year_month, cell_id, sum(m) AS traps FROM (SELECT year_month, cell_id, vessel_id, avg(n) AS m FROM (
        SELECT strftime(date, '%Y_%m') AS year_month, cell_id, vessel_id, ticket_id, count(*) AS n FROM pings GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def mean_per_set_summed(t):
    p = t.pings.withColumn("year_month", cal.year_month("date"))
    k = ["year_month", "cell_id"]
    return ag.two_stage_mean_sum(p, [*k, "vessel_id", "ticket_id"], [*k, "vessel_id"], k, "traps")


@query(
    "price_as_ratio_of_sums", "A10 D42", doubles="rev lbs price", digits=4,
    sql="""SELECT port, year(date) AS year, sum(rev) AS rev, sum(lbs) AS lbs, count(DISTINCT p.ticket_id) AS n_units, sum(rev) / sum(lbs) AS price
        FROM pings p JOIN tickets USING (ticket_id) GROUP BY 1, 2""",
)
def price_as_ratio_of_sums(t):
    j = t.pings.join(t.tickets.select("ticket_id", "port"), "ticket_id").withColumn("year", F.year("date"))
    return ag.ratio_of_sums(j, ["ticket_id", "port", "year"], ["port", "year"], "rev", "lbs", "price")


@query(
    "share_of_group_total", "A11 W9", doubles="lbs share",
    sql="SELECT cell_id, port, lbs, lbs / sum(lbs) OVER (PARTITION BY cell_id) AS share FROM (SELECT cell_id, port, sum(lbs) AS lbs FROM pings JOIN tickets USING (ticket_id) GROUP BY 1, 2)",
)
def share_of_group_total(t):
    j = t.pings.join(t.tickets.select("ticket_id", "port"), "ticket_id")
    return ag.share_of_total(j, ["cell_id", "port"], ["cell_id"], "lbs")


@query(
    "share_weighted_mean", "A12 D40", doubles="distance",
    sql="""SELECT cell_id, sum(share * d) AS distance FROM (SELECT cell_id, port, sum(lbs) / sum(sum(lbs)) OVER (PARTITION BY cell_id) AS share FROM pings JOIN tickets USING (ticket_id) GROUP BY 1, 2)
        JOIN (SELECT port, sqrt(px * px + py * py) AS d FROM ports) USING (port) GROUP BY 1""",
)
def share_weighted_mean(t):
    j = t.pings.join(t.tickets.select("ticket_id", "port"), "ticket_id")
    shares = ag.share_of_total(j, ["cell_id", "port"], ["cell_id"], "lbs")
    d = t.ports.select("port", F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")).alias("d"))
    return ag.weighted_by_share(shares, d, ["port"], ["cell_id"], "share", "d", "distance")


@query(
    "list_aggregates", "A13",
    sql="SELECT cell_id, string_agg(DISTINCT port::VARCHAR, ', ' ORDER BY port::VARCHAR) AS port_list FROM pings JOIN tickets USING (ticket_id) GROUP BY 1",
)
def list_aggregates(t):
    j = t.pings.join(t.tickets.select("ticket_id", "port"), "ticket_id")
    return ag.text_list(j, ["cell_id"], "port", "port_list")


@query(
    "row_of_group_maximum", "A14 O2", doubles="top_pings",
    sql="""SELECT region, arg_max(year_month, (pings, year_month)) AS top_month, CAST(max(pings) AS DOUBLE) AS top_pings FROM (SELECT region, year_month, sum(pings) AS pings FROM effort GROUP BY 1, 2) GROUP BY 1""",
)
def row_of_group_maximum(t):
    g = t.effort.groupBy("region", "year_month").agg(F.sum("pings").cast("double").alias("pings"))
    return g.groupBy("region").agg(
        F.max_by("year_month", F.struct("pings", "year_month")).alias("top_month"), F.max("pings").alias("top_pings")
    )


@query(
    "functional_dependency_breaks", "A15",
    sql="SELECT ticket_id, count(DISTINCT cell_id) AS n_values FROM pings GROUP BY 1 HAVING count(DISTINCT cell_id) > 1",
)
def functional_dependency_breaks(t):
    return ag.functional_dep_breaks(t.pings, ["ticket_id"], "cell_id")


@query(
    "contingency_counts", "A16",
    sql="SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
)
def contingency_counts(t):
    g = t.read("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return g.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query(
    "metric_ranges", "A17 D3", doubles="lo hi", digits=4,
    sql=" UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST(min({m}) AS DOUBLE) AS lo, CAST(max({m}) AS DOUBLE) AS hi FROM (SELECT cell_id, year_month, sum({m}) AS {m} FROM effort GROUP BY 1, 2)"
        for m in ("lbs", "rev", "pings", "vessel_share")
    ),
)
def metric_ranges(t):
    cols = ["lbs", "rev", "pings", "vessel_share"]
    return ag.metric_ranges(t.effort.groupBy("cell_id", "year_month").agg(*[F.sum(c).alias(c) for c in cols]), cols)


@query(
    "duplicate_group_report", "A18", doubles="pct_multi",
    sql="SELECT count(*) AS n_keys, count_if(n > 1) AS n_multi, 100.0 * count_if(n > 1) / count(*) AS pct_multi FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)",
)
def duplicate_group_report(t):
    return ag.duplicate_profile(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "null_profile", "A19",
    sql="""SELECT * FROM (SELECT count_if(l_tax = 0) AS tax, count_if(l_discount = 0) AS discount, 0::BIGINT AS quantity FROM lineitem) UNPIVOT (n_null FOR column_name IN (tax, discount, quantity))""",
)
def null_profile(t):
    li = t.read("lineitem").select(
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"), F.col("l_quantity").alias("quantity")
    )
    return ag.null_profile(li)


@query(
    "event_rates", "A20", doubles="per_year per_month",
    sql="SELECT region, count(*) AS n_events, count(*) / 6.6e0 AS per_year, count(*) / 79e0 AS per_month FROM cases GROUP BY 1",
)
def event_rates(t):
    return ag.rate_table(t.events, ["region"], {"per_year": 6.6, "per_month": 79})


def _integrated_t(p: float, dof: int) -> float:
    """t quantile for the SQL side, by Simpson sums over the density and secant steps."""
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    f = lambda x: c * (1 + x * x / dof) ** (-(dof + 1) / 2)
    t = 0.0
    for _ in range(60):
        h = t / 4000
        area = h / 3 * sum((1 if i in (0, 4000) else 4 if i % 2 else 2) * f(i * h) for i in range(4001)) if t else 0.0
        step = (p - 0.5 - area) / f(t)
        t += step
        if abs(step) < 1e-13:
            break
    return t


# A cell has at most 31 days in a month.
_T = [_integrated_t(0.975, d) for d in range(1, 32)]


@query(
    "mean_with_t_interval", "A21", doubles="mean:7 sd:3 lo:3 hi:3",
    sql=f"""SELECT cell_id, year_month, n, mean, sd, CASE WHEN n > 1 THEN mean - h END AS lo, CASE WHEN n > 1 THEN mean + h END AS hi FROM (
        SELECT *, {_T}[greatest(least(n - 1, {len(_T)}), 1)] * sd / sqrt(n) AS h FROM (
        SELECT cell_id, year_month, count(rev) AS n, avg(rev) AS mean, stddev_samp(rev) AS sd FROM effort GROUP BY 1, 2))""",
)
def mean_with_t_interval(t):
    return ag.mean_ci(t.effort, ["cell_id", "year_month"], "rev")


@query(
    "null_poisoned_sums", "A22", doubles="strict loose",
    sql="""SELECT l_orderkey, CASE WHEN count(x) = count(*) THEN sum(x) END AS strict, coalesce(sum(x), 0) AS loose FROM (SELECT l_orderkey, nullif(l_tax, 0) AS x FROM lineitem) GROUP BY 1""",
)
def null_poisoned_sums(t):
    li = t.read("lineitem").select("l_orderkey", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("x"))
    return li.groupBy("l_orderkey").agg(nl.strict_sum("x").alias("strict"), nl.sum_or_zero("x").alias("loose"))


@query(
    "lines_in_the_water", "A23",
    sql="""SELECT year_month, CAST(sum(n) AS BIGINT) AS n_licences, CAST(sum(n * pot_limit) AS BIGINT) AS max_pots FROM (SELECT strftime(date, '%Y_%m') AS year_month, pot_limit, count(DISTINCT p.vessel_id) AS n
        FROM pings p JOIN permits USING (vessel_id) GROUP BY 1, 2) GROUP BY 1""",
)
def lines_in_the_water(t):
    months = t.pings.select("vessel_id", cal.year_month("date").alias("year_month")).distinct()
    return ag.max_pots(months.join(t.permits, "vessel_id"), ["year_month"], "vessel_id", "pot_limit")


@query(
    "region_and_statewide", "A24", doubles="lbs max_rev",
    sql="SELECT year_month, CASE WHEN grouping(region) = 1 THEN 'All' ELSE region END AS region, sum(lbs) AS lbs, max(rev) AS max_rev FROM effort GROUP BY GROUPING SETS ((year_month, region), (year_month))",
)
def region_and_statewide(t):
    return ag.region_and_total(t.effort, ["year_month"], "region", {"lbs": F.sum("lbs"), "max_rev": F.max("rev")})

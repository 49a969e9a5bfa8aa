"""Ranks, lags, running totals, top-k and set operations over the given tables."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import windows as wn
from ..operators.skew import exact_quantiles, first_per_key
from .core import query


def _vessel_years(t):
    return t.tickets.groupBy("port", F.year("landing_date").alias("year")).agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("n"), F.avg("revenue").alias("mean_rev")
    )


_VY = "(SELECT port, year(landing_date) AS year, sum(revenue) AS revenue, count(*) AS n, avg(revenue) AS mean_rev FROM tickets GROUP BY 1, 2)"


@query(
    "ranks_within_year", "W1",
    sql=f"SELECT port, year, row_number() OVER (PARTITION BY year ORDER BY revenue, port) AS rank_rev, row_number() OVER (PARTITION BY year ORDER BY n, port) AS rank_n FROM {_VY}",
)
def ranks_within_year(t):
    return wn.rank_columns(_vessel_years(t), ["year"], {"rank_rev": "revenue", "rank_n": "n"}, ["port"]).select("port", "year", "rank_rev", "rank_n")


@query(
    "rank_after_descending_sort", "W2 O1",
    sql=f"SELECT port, year, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, mean_rev DESC, port) AS scenario_rank FROM {_VY}",
)
def rank_after_descending_sort(t):
    r = wn.rank_sorted(_vessel_years(t), ["year"], [F.desc("n"), F.desc("mean_rev"), F.col("port")], "scenario_rank")
    return r.select("port", "year", "n", "scenario_rank").orderBy("year", "scenario_rank")


@query(
    "difference_from_previous", "W3",
    sql=f"SELECT port, year, n, n - lag(n, 1, 0) OVER (PARTITION BY port ORDER BY year) AS diff_n FROM {_VY}",
)
def difference_from_previous(t):
    return wn.lag_difference(_vessel_years(t), ["port"], ["year"], {"diff_n": "n"}, 0).select("port", "year", "n", "diff_n")


@query(
    "percent_change_from_previous", "W4", doubles="pct_rev pct_n",
    sql=f"""SELECT port, year, 100 * (revenue - lag(revenue) OVER w) / lag(revenue) OVER w AS pct_rev,
        100 * (n - lag(n) OVER w) / lag(n) OVER w AS pct_n FROM {_VY} WINDOW w AS (PARTITION BY port ORDER BY year)""",
)
def percent_change_from_previous(t):
    return wn.percent_change(_vessel_years(t), ["port"], ["year"], {"pct_rev": "revenue", "pct_n": "n"}).select("port", "year", "pct_rev", "pct_n")


@query(
    "lags_on_completed_spine", "W5", doubles="pings pings_lag1 pings_lag3",
    sql="""SELECT cell_id, crab_year, m, pings, lag(pings, 1) OVER w AS pings_lag1, lag(pings, 3) OVER w AS pings_lag3 FROM (
        SELECT c.cell_id, y.crab_year, r.m, CAST(coalesce(e.pings, 0) AS DOUBLE) AS pings FROM (SELECT DISTINCT cell_id FROM effort) c, (SELECT DISTINCT crab_year FROM effort) y, range(1, 13) r(m)
        LEFT JOIN (SELECT cell_id, crab_year, (month(date) + 1) % 12 + 1 AS m, sum(pings) AS pings FROM effort GROUP BY 1, 2, 3) e ON e.cell_id = c.cell_id AND e.crab_year = y.crab_year AND e.m = r.m)
        WINDOW w AS (PARTITION BY cell_id, crab_year ORDER BY m)""",
)
def lags_on_completed_spine(t):

    e = t.effort.groupBy("cell_id", "crab_year", cal.month_of_crab_year("date").alias("m")).agg(F.sum("pings").cast("double").alias("pings"))
    years = t.effort.select("crab_year")
    months = t.spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    from ..operators.joins import spine

    full = spine(e.select("cell_id"), years, months).join(e, ["cell_id", "crab_year", "m"], "left").fillna(0.0, ["pings"])
    return wn.lag_columns(full, ["cell_id", "crab_year"], ["m"], "pings", [1, 3])


@query(
    "running_percent_of_total", "W6", doubles="running_pct",
    sql="""SELECT region, rev, n, CAST(sum(n) OVER w AS BIGINT) AS running_n, 100.0 * sum(n) OVER w / sum(n) OVER (PARTITION BY region) AS running_pct
        FROM (SELECT region, round(rev, -2) AS rev, count(*) AS n FROM (SELECT region, floor(round(rev, 2) / 100) * 100 AS rev FROM effort) GROUP BY 1, 2) WINDOW w AS (PARTITION BY region ORDER BY rev)""",
)
def running_percent_of_total(t):
    e = t.effort.select("region", (F.floor(F.round("rev", 2) / 100) * 100).cast("double").alias("rev"))
    return wn.running_percent(e, ["region"], "rev")


@query(
    "season_counter", "W7",
    sql="SELECT year_month, sum(flag) OVER (ORDER BY year_month) AS fish_season FROM (SELECT DISTINCT strftime(date, '%Y_%m') AS year_month, (month(date) = 11)::INT AS flag FROM pings)",
)
def season_counter(t):
    months = t.pings.select(cal.year_month("date").alias("year_month")).distinct()
    return wn.season_counter(months, [], ["year_month"], F.substring("year_month", 6, 2) == "11", "fish_season")


@query(
    "first_row_per_key", "W10 U4",
    sql="SELECT vessel_id, ticket_id, landing_date FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY landing_date, ticket_id) AS rn FROM tickets) WHERE rn = 1",
)
def first_row_per_key(t):
    return first_per_key(t.tickets.select("vessel_id", "landing_date", "ticket_id"), ["vessel_id"], ["landing_date"]).select("vessel_id", "ticket_id", "landing_date")


@query(
    "first_and_last_per_key", "W11",
    sql="""SELECT vessel_id, arg_min(ticket_id, (landing_date, ticket_id)) AS first_ticket, arg_max(ticket_id, (landing_date, ticket_id)) AS last_ticket, count(*) AS n_rows FROM tickets GROUP BY 1""",
)
def first_and_last_per_key(t):
    e = wn.ends_of_group(t.tickets.select("vessel_id", "landing_date", "ticket_id"), ["vessel_id"], ["landing_date", "ticket_id"])
    return e.select("vessel_id", F.col("first_row.ticket_id").alias("first_ticket"), F.col("last_row.ticket_id").alias("last_ticket"), "n_rows")


@query(
    "every_second_row", "W11",
    sql="SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn % 2 = 0",
)
def every_second_row(t):
    return wn.every_nth(t.read("conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 2)


@query(
    "groups_of_exact_size", "W12",
    sql="SELECT ticket_id, cell_id, lbs FROM (SELECT *, count(*) OVER (PARTITION BY ticket_id) AS n FROM pings) WHERE n = 2",
)
def groups_of_exact_size(t):
    return wn.group_size_is(t.pings.select("ticket_id", "cell_id", "lbs"), ["ticket_id"], 2)


@query(
    "best_rank_of_group", "W13",
    sql=f"SELECT *, min(r) OVER (PARTITION BY port) AS best FROM (SELECT port, year, row_number() OVER (ORDER BY n DESC, port, year) AS r FROM {_VY})",
)
def best_rank_of_group(t):
    from ..operators.skew import attach_totals

    r = wn.rank_sorted(_vessel_years(t), [], [F.desc("n"), F.col("port"), F.col("year")], "r").select("port", "year", "r")
    return attach_totals(r, ["port"], {"best": F.min("r")})


@query(
    "empirical_cdf_rows", "W14", doubles="ecdf",
    sql="SELECT o_orderkey, o_orderpriority, o_totalprice, cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS ecdf FROM orders",
)
def empirical_cdf_rows(t):
    o = t.read("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return wn.empirical_cdf(o, ["o_orderpriority"], "o_totalprice")


@query(
    "above_group_quantile", "W15", doubles="cut",
    sql="""SELECT cell_id, year_month, dens >= cut AS good, cut FROM cell_month JOIN (SELECT region, quantile_cont(dens, 0.9) AS cut FROM cell_month GROUP BY 1) USING (region)""",
)
def above_group_quantile(t):
    q = exact_quantiles(t.cell_month, ["region"], "dens", {"cut": 0.9})
    return t.cell_month.join(q, "region").select("cell_id", "year_month", (F.col("dens") >= F.col("cut")).alias("good"), "cut")


@query(
    "min_max_rescale", "W16", doubles="global_unit group_unit",
    sql="""SELECT cell_id, year_month, (lbs - min(lbs) OVER ()) / (max(lbs) OVER () - min(lbs) OVER ()) AS global_unit,
        CASE WHEN max(lbs) OVER w = min(lbs) OVER w THEN 0.5e0 ELSE (lbs - min(lbs) OVER w) / (max(lbs) OVER w - min(lbs) OVER w) END AS group_unit
        FROM (SELECT cell_id, year_month, sum(lbs) AS lbs FROM effort GROUP BY 1, 2) WINDOW w AS (PARTITION BY year_month)""",
)
def min_max_rescale(t):
    e = t.effort.groupBy("cell_id", "year_month").agg(F.sum("lbs").alias("lbs"))
    return wn.rescale_min_max(wn.rescale_min_max(e, [], "lbs", "global_unit"), ["year_month"], "lbs", "group_unit").select(
        "cell_id", "year_month", "global_unit", "group_unit"
    )


@query(
    "z_scores", "W17", doubles="z z2",
    sql="""SELECT cell_id, year_month, (rev - avg(rev) OVER ()) / stddev_samp(rev) OVER () AS z,
        (rev - avg(rev) OVER w) / (2 * stddev_samp(rev) OVER w) AS z2 FROM (SELECT cell_id, year_month, substr(year_month, 6, 2) AS m, sum(rev) AS rev FROM effort GROUP BY 1, 2) WINDOW w AS (PARTITION BY m)""",
)
def z_scores(t):
    e = t.effort.groupBy("cell_id", "year_month").agg(F.sum("rev").alias("rev")).withColumn("m", F.substring("year_month", 6, 2))
    return wn.z_score(wn.z_score(e, [], "rev", "z"), ["m"], "rev", "z2", 2.0).select("cell_id", "year_month", "z", "z2")


@query(
    "top_rows_overall", "O3",
    sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_rows_overall(t):
    return t.read("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "top_fraction_rows", "O5",
    sql="""SELECT o_orderkey, o_totalprice FROM (SELECT *, rank() OVER (ORDER BY o_totalprice DESC) AS r, count(*) OVER () AS n FROM orders) WHERE r - 1 < n * 0.05""",
)
def top_fraction_rows(t):
    return wn.top_fraction(t.read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.05)


@query(
    "union_by_name", "U1",
    sql="SELECT label, k, count(*) AS n FROM (SELECT 'c' AS label, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier) GROUP BY 1, 2",
)
def union_by_name(t):
    c = t.read("customer").select(F.lit("c").alias("label"), F.col("c_nationkey").alias("k"))
    s = t.read("supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("label"))
    return c.unionByName(s).groupBy("label", "k").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_rows", "U3", sql="SELECT DISTINCT cell_id, date FROM pings")
def distinct_rows(t):
    return t.pings.select("cell_id", "date").distinct()


@query(
    "whole_row_duplicates", "U5",
    sql="SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) WHERE n > 1",
)
def whole_row_duplicates(t):
    li = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return li.groupBy(*li.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l_orderkey", "l_linenumber", "n")


@query(
    "key_set_differences", "U6",
    sql="""SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)
        UNION ALL SELECT 'first', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)
        UNION ALL SELECT 'second', count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 EXCEPT SELECT o_custkey FROM orders)""",
)
def key_set_differences(t):
    a = t.read("orders").select(F.col("o_custkey").alias("k"))
    b = t.read("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    size = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return size(a.intersect(b), "both").unionByName(size(a.subtract(b), "first")).unionByName(size(b.subtract(a), "second"))


@query(
    "split_transform_reunite", "U7", doubles="rev", digits=4,
    sql="SELECT crab_year, sum(CASE WHEN region IN ('OR', 'WA') AND month(date) BETWEEN 5 AND 9 THEN rev * 0.66 ELSE rev END) AS rev FROM effort GROUP BY 1",
)
def split_transform_reunite(t):
    cut = F.col("region").isin("OR", "WA") & cal.is_may_sep("date")
    return t.effort.groupBy("crab_year").agg(F.sum(F.when(cut, F.col("rev") * 0.66).otherwise(F.col("rev"))).alias("rev"))

"""Join operators over the given tables."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import joins as jn
from ..operators.spatial import nearest
from ..plans.tradeoff import relative_to_baseline
from ..session import staged
from .core import query

OD = "CAST(o_orderdate AS DATE)"


def _vessels(t):
    return t.tickets.groupBy("vessel_id").agg(F.count(F.lit(1)).alias("n_tickets"), F.max("landing_date").alias("last_date"))


@query("inner_join_counts", "J1", sql="SELECT port, count(*) AS n FROM pings JOIN tickets USING (ticket_id) GROUP BY 1")
def inner_join_counts(t):
    return t.pings.select("ticket_id").join(t.tickets.select("ticket_id", "port"), "ticket_id").groupBy("port").agg(F.count(F.lit(1)).alias("n"))


@query(
    "left_join_renamed_keys", "J2", doubles="occ pings",
    sql="""SELECT e.cell_id, e.year_month, CAST(pings AS DOUBLE) AS pings, occ FROM (SELECT cell_id, year_month, sum(pings) AS pings FROM effort GROUP BY 1, 2) e
        LEFT JOIN (SELECT cell_id AS grid_id, year_month AS ym, occ FROM species) s ON e.cell_id = s.grid_id AND e.year_month = s.ym""",
)
def left_join_renamed_keys(t):
    e = t.effort.groupBy("cell_id", "year_month").agg(F.sum("pings").cast("double").alias("pings"))
    s = t.species.select(F.col("cell_id").alias("grid_id"), F.col("year_month").alias("ym"), "occ")
    return e.join(s, (F.col("cell_id") == F.col("grid_id")) & (F.col("year_month") == F.col("ym")), "left").drop("grid_id", "ym")


@query(
    "left_join_null_keys", "J2",
    sql="""SELECT o_orderkey, a.k, n FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS k FROM orders) a LEFT JOIN (
        SELECT nullif(o_orderpriority, '5-LOW') AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""",
)
def left_join_null_keys(t):
    a = t.read("orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("k"))
    return jn.left_join_null_safe(a, a.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])


@query(
    "full_join_suffixes", "J3",
    sql="""SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, coalesce(a.year_month, b.year_month) AS year_month, a.n AS n_x, b.n AS n_y FROM
        (SELECT cell_id, strftime(date, '%Y_%m') AS year_month, count(*) AS n FROM pings GROUP BY 1, 2) a FULL JOIN
        (SELECT l_partkey % 400 AS cell_id, strftime(l_shipdate, '%Y_%m') AS year_month, count(*) AS n FROM lineitem GROUP BY 1, 2) b
        ON a.cell_id = b.cell_id AND a.year_month = b.year_month""",
)
def full_join_suffixes(t):
    a = t.pings.groupBy("cell_id", cal.year_month("date").alias("year_month")).agg(F.count(F.lit(1)).alias("n"))
    b = t.read("lineitem").groupBy((F.col("l_partkey") % 400).alias("cell_id"), cal.year_month("l_shipdate").alias("year_month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return jn.full_join_suffixed(a, b, ["cell_id", "year_month"])


@query(
    "right_join_all_cells", "J4",
    sql="""SELECT g.cell_id, g.region, n FROM (SELECT cell_id, count(*) AS n FROM pings WHERE cell_id % 7 <> 3 GROUP BY 1) p RIGHT JOIN grid g ON p.cell_id = g.cell_id""",
)
def right_join_all_cells(t):
    p = t.pings.where("cell_id % 7 <> 3").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    return p.join(t.grid.select("cell_id", "region"), "cell_id", "right").select("cell_id", "region", "n")


@query(
    "semi_join_active_cells", "J5 G22",
    sql="""SELECT year_month, count(*) AS n FROM species WHERE cell_id IN (SELECT cell_id FROM pings WHERE cell_id % 7 <> 3) GROUP BY 1""",
)
def semi_join_active_cells(t):
    active = t.pings.where("cell_id % 7 <> 3")
    return jn.keep_matching(t.species, active, ["cell_id"]).groupBy("year_month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "anti_join_unseen_tickets", "J6",
    sql="SELECT ticket_id, port FROM tickets WHERE ticket_id NOT IN (SELECT l_orderkey FROM lineitem)",
)
def anti_join_unseen_tickets(t):
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("ticket_id"))
    return jn.drop_matching(t.tickets, lines, ["ticket_id"]).select("ticket_id", "port")


@query(
    "combination_spine", "J7 R4",
    sql="""SELECT c.cell_id, y.cy AS crab_year, h.half_month FROM (SELECT DISTINCT cell_id FROM pings) c,
        (SELECT DISTINCT CASE WHEN month(date) >= 11 THEN year(date) || '_' || (year(date) + 1) ELSE (year(date) - 1) || '_' || year(date) END AS cy FROM pings) y,
        (SELECT DISTINCT monthname(date) || '_' || CASE WHEN day(date) <= 15 THEN 1 ELSE 2 END AS half_month FROM pings) h""",
)
def combination_spine(t):
    p = t.pings
    years = p.select(cal.crab_year("date").alias("crab_year"))
    halves = p.select(cal.half_month("date").alias("half_month"))
    return jn.spine(p.select("cell_id"), years, halves)


@query(
    "permit_interval_join", "J8", doubles="lbs",
    sql="""SELECT p.vessel_id, pot_limit, count(*) AS n, sum(lbs) AS lbs FROM pings p JOIN permits m ON p.vessel_id = m.vessel_id
        AND date BETWEEN begin_date AND end_date GROUP BY 1, 2""",
)
def permit_interval_join(t):
    # Pings collapse to vessel-days first: the join sees days, not pings. Staged, because the join also looks at how dates are spread.
    days = staged(t.pings.groupBy("vessel_id", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("lbs").alias("lbs")))
    j = jn.interval_join(days, t.permits, "vessel_id", "date", "begin_date", "end_date")
    return j.groupBy("vessel_id", "pot_limit").agg(F.sum("n").alias("n"), F.sum("lbs").alias("lbs"))


@query(
    "band_range_join", "J9",
    sql=f"""SELECT s_suppkey, c_custkey FROM supplier JOIN (SELECT c_custkey, c_acctbal AS lo, c_acctbal + 3 AS hi FROM customer) ON s_acctbal >= lo AND s_acctbal < hi""",
)
def band_range_join(t):
    bands = t.read("customer").select("c_custkey", F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 3).alias("hi"))
    return jn.range_join(t.read("supplier").select("s_suppkey", "s_acctbal"), bands, "s_acctbal", "lo", "hi", 3.0).select("s_suppkey", "c_custkey")


@query(
    "event_lookback_rows", "J10", doubles="pings",
    sql="""SELECT case_id, lag_months, CAST(pings AS DOUBLE) AS pings FROM (SELECT case_id, region, k AS lag_months, strftime(month_start - to_months(CAST(k AS INT)), '%Y_%m') AS ym
        FROM cases, range(4) r(k)) x LEFT JOIN (SELECT region, year_month, sum(pings) AS pings FROM effort GROUP BY 1, 2) s ON x.region = s.region AND x.ym = s.year_month""",
)
def event_lookback_rows(t):
    s = t.effort.groupBy("region", F.trunc("date", "month").alias("m")).agg(F.sum("pings").cast("double").alias("pings"))
    return jn.lookback_join(t.events, s, ["region"], "month_start", "m", 3).select("case_id", "lag_months", "pings")


@query(
    "price_fallback_join", "J11", doubles="price",
    sql="""SELECT p.port, y.year, coalesce(a.price, b.price, CASE WHEN p.port = 2 THEN 1.49e0 WHEN p.port = 5 THEN 1.19e0 END) AS price
        FROM (SELECT DISTINCT port FROM tickets) p, (SELECT DISTINCT year(landing_date) AS year FROM tickets) y
        LEFT JOIN prices a ON a.port = p.port AND a.year = y.year
        LEFT JOIN prices b ON b.port = (CASE p.port WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN 2 WHEN 6 THEN 7 WHEN 8 THEN 9 WHEN 10 THEN 11 END) AND b.year = y.year"""
    .replace("prices", "(SELECT port, year(landing_date) AS year, avg(revenue) AS price FROM tickets GROUP BY 1, 2 HAVING avg(revenue) >= 250000)"),
)
def price_fallback_join(t):
    k = t.tickets.select("port", F.year("landing_date").alias("year"), "revenue")
    prices = k.groupBy("port", "year").agg(F.avg("revenue").alias("price")).where("price >= 250000")
    full = jn.spine(k.select("port"), k.select("year"))
    neighbours = {0: 1, 2: 3, 4: 5, 5: 2, 6: 7, 8: 9, 10: 11}
    return jn.fallback_join(full, prices, "port", ["year"], "price", neighbours, {2: 1.49, 5: 1.19})


@query(
    "key_match_report", "J12", doubles="match_rate",
    sql="""SELECT count(*) AS n_rows, count(b.c_custkey) AS n_matched, count(b.c_custkey) / count(*) AS match_rate FROM orders
        LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1) b ON o_custkey = c_custkey""",
)
def key_match_report(t):
    c = t.read("customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("o_custkey"))
    return jn.match_report(t.read("orders"), c, ["o_custkey"])


@query(
    "nearest_port_of_cell", "J15 G5", doubles="dist",
    sql="""SELECT cell_id, arg_min(port, (d, port)) AS port, min(d) AS dist FROM (SELECT cell_id, port, sqrt((gx - px) ** 2 + (gy - py) ** 2) AS d FROM grid, ports) GROUP BY 1""",
)
def nearest_port_of_cell(t):
    cells = t.grid.select("cell_id", F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"))
    ports = t.ports.select("port", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))
    return nearest(cells, ports, ["cell_id"], "port").select("cell_id", "port", "dist")


@query(
    "checked_dimension_join", "J16",
    sql="SELECT region, bia, count(*) AS n FROM pings JOIN grid USING (cell_id) GROUP BY 1, 2",
)
def checked_dimension_join(t):
    g = t.pings.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    return jn.join_checked(g, t.grid.select("cell_id", "region", "bia"), ["cell_id"]).groupBy("region", "bia").agg(F.sum("n").alias("n"))


@query(
    "baseline_relative_rows", "J17 W8", doubles="rev rev_base", digits=2,
    sql=f"""SELECT crab_year, region, rev, max(rev) FILTER (region = 'CenCA') OVER (PARTITION BY crab_year) AS rev_base FROM (
        SELECT crab_year, region, sum(rev) AS rev FROM effort GROUP BY 1, 2)""",
)
def baseline_relative_rows(t):
    g = t.effort.groupBy("crab_year", "region").agg(F.sum("rev").alias("rev"))
    return relative_to_baseline(g, ["crab_year"], F.col("region") == "CenCA", ["rev"])


@query(
    "superseding_stage_join", "J18", doubles="depth area",
    sql="""SELECT g.cell_id, g.area, d.depth, d.n FROM grid g LEFT JOIN (SELECT cell_id, -avg(lbs) AS depth, count(*) AS n FROM pings WHERE lbs > 10 GROUP BY 1) d USING (cell_id)""",
)
def superseding_stage_join(t):
    new = t.pings.where("lbs > 10").groupBy("cell_id").agg((-F.avg("lbs")).alias("depth"), F.count(F.lit(1)).alias("n"))
    return jn.replace_columns_join(t.grid.select("cell_id", "area", "depth"), new, ["cell_id"])

"""Effort operators over the given tables."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.skew import with_scalars
from ..plans import effort as eff
from .bindings import crab_year_sql
from .core import query


@query(
    "trip_allocation", "D1", doubles="revenue_per_ping vessel_share", digits=5,
    sql="""SELECT p.ticket_id, p.cell_id, p.lbs, t.revenue / trip_pings AS revenue_per_ping, 1e0 / trip_pings AS vessel_share
        FROM pings p JOIN trip_size s ON p.ticket_id = s.ticket_id JOIN tickets t ON p.ticket_id = t.ticket_id""",
)
def trip_allocation(t):
    a = eff.allocate_trip(t.pings, t.tickets, "ticket_id", ["revenue"])
    return a.select("ticket_id", "cell_id", "lbs", "revenue_per_ping", "vessel_share")


@query(
    "effort_daily", "D2", doubles="lbs rev vessel_share", digits=5,
    sql="SELECT crab_year, year_month, date, cell_id, region, depth, bia, lbs, rev, pings, vessel_share, vessels FROM effort",
)
def effort_daily(t):
    return t.effort.select("crab_year", "year_month", "date", "cell_id", "region", "depth", "bia", *eff.METRICS)


@query(
    "effort_daily_by_vessel_size", "D2", doubles="lbs", digits=5,
    sql="""SELECT date, cell_id, size_class, sum(lbs) AS lbs, count(*) AS pings, count(DISTINCT vessel_id) AS vessels FROM (
        SELECT *, CASE WHEN vessel_id % 5 < 2 THEN 'small' ELSE 'large' END AS size_class FROM pings) GROUP BY 1, 2, 3""",
)
def effort_daily_by_vessel_size(t):
    p = t.pings.withColumn("size_class", F.when(F.col("vessel_id") % 5 < 2, "small").otherwise("large"))
    return eff.effort_daily(p, ["size_class"]).select("date", "cell_id", "size_class", "lbs", "pings", "vessels")


@query(
    "effort_monthly", "D3", doubles="lbs rev vessel_share", digits=5,
    sql="""SELECT strftime(date, '%Y_%m') AS year_month, cell_id, sum(lbs) AS lbs, sum(rev) AS rev, count(*) AS pings, sum(1e0 / trip_pings) AS vessel_share,
        count(DISTINCT vessel_id) AS vessels FROM pings JOIN trip_size USING (ticket_id) GROUP BY 1, 2""",
)
def effort_monthly(t):
    return eff.effort_monthly(t.pings)


@query(
    "min_max_with_floor", "D4", doubles="n_pings", digits=9,
    sql="""SELECT cell_id, year_month, CASE WHEN p = lo THEN 0.5e0 * (second - lo) / (hi - lo) ELSE (p - lo) / (hi - lo) END AS n_pings FROM (
        SELECT *, min(p) OVER () AS lo, max(p) OVER () AS hi, (SELECT min(q) FROM (SELECT DISTINCT p AS q FROM m) WHERE q > (SELECT min(p) FROM m)) AS second FROM m)"""
    .replace("FROM m)", "FROM (SELECT cell_id, year_month, sum(pings) AS p FROM effort GROUP BY 1, 2))"),
)
def min_max_with_floor(t):
    e = t.effort.groupBy("cell_id", "year_month").agg(F.sum("pings").alias("p"))
    return eff.normalize_floor(e, "p", "n_pings").select("cell_id", "year_month", "n_pings")


@query(
    "normalise_to_status_quo", "D5", doubles="n_lbs", digits=8,
    sql="""WITH m AS (SELECT cell_id, year_month, sum(lbs) AS lbs FROM effort GROUP BY 1, 2) SELECT cell_id, year_month, (lbs * 0.8e0 - lo) / (hi - lo) AS n_lbs
        FROM m, (SELECT min(lbs) AS lo, max(lbs) AS hi FROM m)""",
)
def normalise_to_status_quo(t):
    e = t.effort.groupBy("cell_id", "year_month").agg(F.sum("lbs").alias("lbs"))
    r = with_scalars(e, e, {"lo": F.min("lbs"), "hi": F.max("lbs")})
    return r.select("cell_id", "year_month", eff.normalize_to(F.col("lbs") * 0.8, F.col("lo"), F.col("hi")).alias("n_lbs"))


@query(
    "confidential_cells", "D34", doubles="lbs rev", digits=4,
    sql="""SELECT cell_id, year_month, n_vessels, CASE WHEN n_vessels >= 3 THEN lbs END AS lbs, CASE WHEN n_vessels >= 3 THEN rev END AS rev, n_vessels < 3 AS confidential FROM (
        SELECT cell_id, strftime(date, '%Y_%m') AS year_month, count(DISTINCT vessel_id) AS n_vessels, sum(lbs) AS lbs, sum(rev) AS rev FROM pings GROUP BY 1, 2)""",
)
def confidential_cells(t):
    return eff.suppress(t.pings.withColumn("year_month", cal.year_month("date")), ["cell_id", "year_month"], "vessel_id", ["lbs", "rev"])


@query(
    "confidentiality_loss", "D34", doubles="value_withheld",
    sql=f"""SELECT crab_year, count(*) AS n_groups, count_if(nv < 3) AS n_withheld, coalesce(sum(v) FILTER (nv < 3), 0) / sum(v) AS value_withheld FROM (
        SELECT {crab_year_sql('date')} AS crab_year, cell_id, strftime(date, '%Y_%m') AS ym, count(DISTINCT vessel_id) AS nv, sum(lbs) AS v FROM pings GROUP BY 1, 2, 3) GROUP BY 1""",
)
def confidentiality_loss(t):
    p = t.pings.withColumns({"ym": cal.year_month("date"), "crab_year": cal.crab_year("date")})
    return eff.suppression_loss(p, ["crab_year", "cell_id", "ym"], ["crab_year"], "vessel_id", "lbs")


@query(
    "fishery_persistence", "D46",
    sql="""SELECT cell_id, n_seasons, CASE WHEN n_seasons = 0 THEN '0' WHEN n_seasons <= 2 THEN '1-2' WHEN n_seasons <= 4 THEN '3-4' WHEN n_seasons <= 6 THEN '5-6' WHEN n_seasons <= 8 THEN '7-8' ELSE '9-10' END AS persistence FROM (
        SELECT grid.cell_id, count(DISTINCT crab_year) AS n_seasons FROM grid LEFT JOIN (SELECT cell_id, crab_year FROM effort WHERE month(date) IN (11, 12, 1, 2, 3, 4)) e ON e.cell_id = grid.cell_id GROUP BY 1)""",
)
def fishery_persistence(t):
    """Winter seasons per cell; cells of the grid without effort make the class of the never fished."""
    winter = t.effort.where(F.month("date").isin(11, 12, 1, 2, 3, 4))
    return eff.persistence(winter, t.grid, "cell_id", "crab_year")

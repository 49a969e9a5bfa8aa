"""Reshaping over the given tables."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import reshape as rs
from .core import query

@query(
    "dated_columns_to_long", "R1", doubles="dens",
    sql="""SELECT c.cell_id, m.d AS date, dens FROM (SELECT DISTINCT cell_id FROM species) c, (SELECT DISTINCT CAST(strptime(year_month || '_01', '%Y_%m_%d') AS DATE) AS d, year_month AS ym FROM species) m
        LEFT JOIN species s ON s.cell_id = c.cell_id AND s.year_month = m.ym""",
)
def dated_columns_to_long(t):
    # The wide form names its columns, so the months are listed first: one row per month of the predictions.
    months = sorted(r[0] for r in t.species.select("year_month").distinct().collect())
    wide = rs.pivot_values(t.species, ["cell_id"], "year_month", months, {"v": F.first("dens")})
    named = wide.withColumnsRenamed({m: f"Avg_Monthly_{m}_01" for m in months})
    return rs.dated_columns_to_long(named, ["cell_id"], "dens")


@query(
    "long_to_wide", "R2", doubles=" ".join(f"m{i}" for i in range(1, 13)),
    sql="SELECT region, " + ", ".join(f"sum(lbs) FILTER (month(date) = {i}) AS m{i}" for i in range(1, 13)) + " FROM effort GROUP BY 1",
)
def long_to_wide(t):
    e = t.effort.withColumn("m", F.concat(F.lit("m"), F.month("date").cast("string")))
    return rs.pivot_values(e, ["region"], "m", [f"m{i}" for i in range(1, 13)], {"lbs": F.sum("lbs")})


@query(
    "complete_combinations", "R4", doubles="pings",
    sql="""SELECT c.cell_id, m.year_month, CAST(coalesce(p, 0) AS DOUBLE) AS pings FROM (SELECT DISTINCT cell_id FROM pings) c, (SELECT DISTINCT strftime(date, '%Y_%m') AS year_month FROM pings) m
        LEFT JOIN (SELECT cell_id, strftime(date, '%Y_%m') AS year_month, count(*) AS p FROM pings GROUP BY 1, 2) e ON e.cell_id = c.cell_id AND e.year_month = m.year_month""",
)
def complete_combinations(t):
    e = t.pings.groupBy("cell_id", cal.year_month("date").alias("year_month")).agg(F.count(F.lit(1)).cast("double").alias("pings"))
    return rs.complete(e, ["cell_id"], e.select("year_month"), {"pings": 0.0})


@query(
    "complete_year_sequence", "R5",
    sql="""SELECT g.vessel_id, g.year, coalesce(n, 0) AS n FROM (SELECT vessel_id, unnest(range(min(y), max(y) + 1)) AS year FROM (SELECT vessel_id, year(landing_date) AS y FROM tickets) GROUP BY 1) g
        LEFT JOIN (SELECT vessel_id, year(landing_date) AS year, count(*) AS n FROM tickets GROUP BY 1, 2) e ON g.vessel_id = e.vessel_id AND g.year = e.year""",
)
def complete_year_sequence(t):
    e = t.tickets.groupBy("vessel_id", F.year("landing_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return rs.complete_years(e, ["vessel_id"], "year", {"n": 0})


@query(
    "nested_list_explode", "R6", doubles="value",
    sql="SELECT vec_id, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) * 2 AS value FROM embeddings, range(1, 1001) r(i) WHERE i <= len(embedding)",
)
def nested_list_explode(t):
    doubled = F.transform("embedding", lambda v: v.cast("double") * 2)
    return t.read("embeddings").select("vec_id", F.posexplode(doubled).alias("pos", "value"))


@query(
    "transition_matrix", "R7",
    sql="SELECT home, " + ", ".join(f"count(DISTINCT vessel_id) FILTER (used = {i}) AS p{i}" for i in range(5))
    + """ FROM (SELECT vessel_id, cell_id % 5 AS used, home FROM pings JOIN (SELECT vessel_id, arg_min(cell_id % 5, (date, ticket_id, cell_id % 5)) AS home FROM pings GROUP BY 1) USING (vessel_id)) GROUP BY 1""",
)
def transition_matrix(t):
    p = t.pings.select("vessel_id", "date", "ticket_id", (F.col("cell_id") % 5).alias("used"))
    home = p.groupBy("vessel_id").agg(F.min_by("used", F.struct("date", "ticket_id", "used")).alias("home"))
    m = rs.transition_matrix(p.join(home, "vessel_id"), "vessel_id", "home", "used", range(5))
    return m.withColumnsRenamed({str(i): f"p{i}" for i in range(5)})

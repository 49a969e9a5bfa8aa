"""Logbook lines to pots, weights, densities and calibrated totals."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.joins import spine
from ..plans import logbook as lb
from .bindings import CTES, half_month_sql, rollover_sql
from .core import query

CTES["pot_rows"] = """SELECT * FROM (SELECT l.*, l.x1 + (i - 0.5e0) / pots * (x2 - x1) AS x, l.y1 + (i - 0.5e0) / pots * (y2 - y1) AS y FROM lines l, range(1, 21) r(i)
    WHERE i <= pots AND sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) < 6000 AND NOT (x1 = x2 AND y1 = y2 AND pots > 50))"""
CTES["pot_points"] = f"""SELECT p.set_id, vessel, pot_limit, set_date, {rollover_sql('set_date', 12, '-')} AS season, {half_month_sql('set_date')} AS half_month,
    CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 1000) AS BIGINT) AS cy, b.depth * 0.1e0 AS depth FROM pot_rows p
    JOIN bathymetry b ON ix = CAST(floor(x / 500) AS BIGINT) AND iy = CAST(floor(y / 500) AS BIGINT)
    WHERE (b.depth * 0.1e0 <= 0 AND b.depth * 0.1e0 > -200) OR b.depth * 0.1e0 < -5000"""
CTES["pot_cells"] = "SELECT season, half_month, vessel, pot_limit, set_id, cx, cy, count(*) AS n_pots FROM pot_points GROUP BY ALL"
_RED = "half_month LIKE 'July%' OR half_month LIKE 'August%'"
CTES["pot_weighted"] = f"""SELECT *, limit_used / sum(n_pots) OVER (PARTITION BY season, half_month, vessel, pot_limit, limit_used) AS pot_weight FROM (
    SELECT *, CASE WHEN {_RED} THEN CASE WHEN pot_limit = 500 THEN 330 ELSE 200 END ELSE pot_limit END AS limit_used FROM pot_cells)"""


def _points(t):
    lines = lb.filter_lines(t.lines.withColumn("len", F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)), "len", "pots", 6000.0)
    p = lb.pots_from_logs(lines, t.bathymetry, "pots", 1000.0, 500.0)
    return p.withColumns({"season": cal.season("set_date"), "half_month": cal.half_month("set_date")})


def _cells(t):
    """Pots pre-aggregated to one row per set and cell."""
    return _points(t).groupBy("season", "half_month", "vessel", "pot_limit", "set_id", "cx", "cy").agg(F.count(F.lit(1)).alias("n_pots"))


def _weighted(t):
    reduced = F.col("half_month").like("July%") | F.col("half_month").like("August%")
    return lb.pot_weights(_cells(t), ["season", "half_month"], "vessel", "pot_limit", reduced)


@query(
    "logbook_compile", "D52 J3 P15",
    sql=f"""SELECT season || '_' || k || '_' || set_no AS set_key, CAST(CASE WHEN year(sd) <> s AND year(sd) <> s + 1 THEN sd - INTERVAL 1 YEAR ELSE sd END AS DATE) AS set_date, landed FROM (
        SELECT coalesce(o_orderkey, l_orderkey) AS k, {rollover_sql('CAST(o_orderdate AS DATE)', 12, '-')} AS season, o_totalprice AS landed, l_linenumber AS set_no, CAST(l_shipdate AS DATE) AS sd,
        CASE WHEN month(o_orderdate) >= 12 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS s FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey)""",
)
def logbook_compile(t):
    h = t.read("orders").select(F.col("o_orderkey").alias("k"), cal.season(F.col("o_orderdate").cast("date")).alias("season"), F.col("o_totalprice").alias("landed"))
    s = t.read("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("set_no"), F.col("l_shipdate").cast("date").alias("set_date"))
    return lb.compile_logbooks(h, s, "k").select("set_key", "set_date", "landed")


@query(
    "endpoints_to_lines", "G6 W12", doubles="x1 y1 x2 y2",
    sql="""SELECT set_id, vessel, x1, y1, x2, y2 FROM lines WHERE x1 <= 500""",
)
def endpoints_to_lines(t):
    ends = t.lines.select("set_id", "vessel", F.col("x1").alias("first_x"), F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.lit(2).alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y")),
    )).alias("e")).select("set_id", "vessel", "first_x", "e.*")
    # Sets that begin east of 500 m lack their second end; repeated rows must not count twice.
    broken = ends.where("NOT (first_x > 500 AND seq = 2)")
    return lb.endpoints_to_lines(broken.unionByName(broken.where("y > 0")), "set_id", "seq", "x", "y", ["vessel"])


@query(
    "line_quality_filter", "G10 G11", doubles="len",
    sql="""SELECT set_id, pots, len FROM (SELECT *, CASE WHEN x1 > 1000 THEN 0 ELSE sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) END AS len FROM lines)
        WHERE len < 2500 AND NOT (len = 0 AND pots > 10)""",
)
def line_quality_filter(t):
    l = t.lines.withColumn("len", F.when(F.col("x1") > 1000, 0.0).otherwise(F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)))
    return lb.filter_lines(l, "len", "pots", 2500.0, 10).select("set_id", "pots", "len")


@query(
    "pots_from_logs", "D31 J13 G9 G11",
    sql="SELECT season, half_month, cx, cy, count(*) AS n_pots, count(DISTINCT set_id) AS n_sets FROM pot_points GROUP BY 1, 2, 3, 4",
)
def pots_from_logs(t):
    return _cells(t).groupBy("season", "half_month", "cx", "cy").agg(F.sum("n_pots").alias("n_pots"), F.countDistinct("set_id").alias("n_sets"))


@query(
    "pot_limit_weights", "D32", doubles="pot_weight", digits=8,
    sql="SELECT season, half_month, vessel, pot_limit, CAST(max(limit_used) AS INT) AS limit_used, max(pot_weight) AS pot_weight, CAST(sum(n_pots) AS BIGINT) AS n_pots FROM pot_weighted GROUP BY 1, 2, 3, 4",
)
def pot_limit_weights(t):
    return _weighted(t).groupBy("season", "half_month", "vessel", "pot_limit").agg(
        F.max("limit_used").alias("limit_used"), F.max("pot_weight").alias("pot_weight"), F.sum("n_pots").alias("n_pots")
    )


@query(
    "trap_density_two_ways", "D33 A9", doubles="m1_traps m2_traps m1_density m2_density", digits=8,
    sql="""SELECT season, half_month, cx, cy, sum(m) AS m1_traps, count(*) AS n_vessels, sum(w) AS m2_traps, sum(m) / 4e0 AS m1_density, sum(w) / 4e0 AS m2_density FROM (
        SELECT season, half_month, cx, cy, vessel, avg(n) AS m, sum(w) AS w FROM (SELECT season, half_month, cx, cy, vessel, set_id, sum(n_pots) AS n, sum(n_pots * pot_weight) AS w FROM pot_weighted GROUP BY ALL) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""",
)
def trap_density_two_ways(t):
    return lb.m1_m2_density(_weighted(t), ["season", "half_month"], "set_id", "vessel", ["cx", "cy"], 4.0)


@query(
    "ticket_calibrated_pots", "D35 A23", doubles="calibrated", digits=6,
    sql=f"""WITH p AS (SELECT strftime(date, '%Y_%m') AS year_month, cell_id, vessel_id, pot_limit FROM pings JOIN permits USING (vessel_id)),
        c AS (SELECT year_month, cell_id, count(*) AS n FROM p GROUP BY 1, 2),
        lg AS (SELECT year_month, sum(pot_limit) AS lp FROM (SELECT DISTINCT year_month, vessel_id, pot_limit FROM p JOIN grid USING (cell_id) WHERE depth < -100) GROUP BY 1),
        tk AS (SELECT year_month, sum(pot_limit) AS tp FROM (SELECT DISTINCT strftime(landing_date, '%Y_%m') AS year_month, vessel_id, pot_limit FROM tickets JOIN permits USING (vessel_id)) GROUP BY 1)
        SELECT c.year_month, cell_id, n * CASE WHEN region = 'WA' AND substr(c.year_month, 6, 2) BETWEEN '05' AND '09' THEN 0.66e0 ELSE 1 END * tp / lp AS calibrated
        FROM c JOIN (SELECT cell_id, region FROM grid) USING (cell_id) LEFT JOIN lg USING (year_month) LEFT JOIN tk USING (year_month)""",
)
def ticket_calibrated_pots(t):
    p = t.pings.select("vessel_id", "cell_id", cal.year_month("date").alias("year_month")).groupBy("year_month", "cell_id", "vessel_id").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(t.permits, "vessel_id")
    cells = p.groupBy("year_month", "cell_id").agg(F.sum("n").alias("n")).join(t.grid.select("cell_id", "region"), "cell_id")
    summer = (F.col("region") == "WA") & F.substring("year_month", 6, 2).between("05", "09")
    tickets = t.tickets.select("vessel_id", cal.year_month("landing_date").alias("year_month")).distinct().join(t.permits, "vessel_id")
    return lb.calibrate_to_tickets(cells, p.join(t.grid.where("depth < -100").select("cell_id"), "cell_id", "left_semi"), tickets, ["year_month"], "vessel_id", "pot_limit", "n", reduced=summer, factor=0.66).select("year_month", "cell_id", "calibrated")


@query(
    "sample_expansion", "D36", doubles="expanded", digits=6,
    sql="""SELECT year_month, cell_id, n + n / sum(n) OVER w * (sum(n) OVER w / 0.3e0 * 0.7e0) AS expanded FROM (SELECT strftime(date, '%Y_%m') AS year_month, cell_id, count(*) AS n FROM pings GROUP BY 1, 2) WINDOW w AS (PARTITION BY year_month)""",
)
def sample_expansion(t):
    c = t.pings.groupBy(cal.year_month("date").alias("year_month"), "cell_id").agg(F.count(F.lit(1)).alias("n"))
    return lb.expand_sample(c, ["year_month"], "n", 0.3).select("year_month", "cell_id", "expanded")


@query(
    "response_on_spine", "D37 R4 P29", doubles="total",
    sql="""SELECT c.cell_id, m.year_month, coalesce(a, 0) + coalesce(b, 0) AS total FROM (SELECT DISTINCT cell_id FROM pings) c, (SELECT DISTINCT strftime(date, '%Y_%m') AS year_month FROM pings) m
        LEFT JOIN (SELECT cell_id AS ac, strftime(date, '%Y_%m') AS am, sum(lbs) AS a FROM pings WHERE vessel_id % 2 = 0 GROUP BY 1, 2) ON ac = c.cell_id AND am = m.year_month
        LEFT JOIN (SELECT cell_id AS bc, strftime(date, '%Y_%m') AS bm, sum(lbs) AS b FROM pings WHERE vessel_id % 2 = 1 GROUP BY 1, 2) ON bc = c.cell_id AND bm = m.year_month""",
)
def response_on_spine(t):
    p = t.pings.withColumn("year_month", cal.year_month("date"))
    keys = ["cell_id", "year_month"]
    full = spine(p.select("cell_id"), p.select("year_month"))
    return lb.response_table(full, {"wa": p.where("vessel_id % 2 = 0"), "orr": p.where("vessel_id % 2 = 1")}, keys, "lbs", "total")


@query(
    "active_licences", "D55",
    sql="""SELECT strftime(landing_date, '%Y_%m') AS year_month, CASE pot_limit WHEN 200 THEN 300 ELSE pot_limit END AS tier, count(DISTINCT vessel_id) AS n_licences FROM tickets JOIN permits USING (vessel_id) GROUP BY 1, 2""",
)
def active_licences(t):
    j = t.tickets.select("vessel_id", cal.year_month("landing_date").alias("year_month")).distinct().join(t.permits, "vessel_id")
    return lb.active_licences(j, ["year_month"], "vessel_id", "pot_limit", {200: 300, 330: 500})

"""Covariates, prices, revenue and fleet movement over the given tables."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.asof import asof_join
from ..operators.joins import spine
from ..operators.skew import exact_quantiles
from ..operators.spatial import cut_lines, distance_to_nearest, nearest
from ..plans import features as ft
from ..session import staged
from .bindings import CTES, crab_year_sql
from .core import query
from .spatial import PIECES

CTES["slot_status"] = """SELECT cell_id, crab_year AS season, (month(date) + 1) % 12 + 1 AS slot, sum(pings) >= 3 AS is_open FROM effort GROUP BY 1, 2, 3"""
CTES["slot_spine"] = "SELECT c.cell_id, s.season, r.slot FROM (SELECT DISTINCT cell_id FROM effort) c, (SELECT DISTINCT crab_year AS season FROM effort) s, range(1, 13) r(slot)"


def _status(t):
    return t.effort.groupBy("cell_id", F.col("crab_year").alias("season"), cal.month_of_crab_year("date").alias("slot")).agg((F.sum("pings") >= 3).alias("is_open"))


def _slot_spine(t, status):
    slots = t.spark.range(1, 13).select(F.col("id").cast("int").alias("slot"))
    return spine(status.select("cell_id"), status.select("season"), slots)


_MONTH_OF = "CAST(substr(m.year_month, 6, 2) AS INT)"


@query(
    "covariate_table", "D38", doubles="lbs dens depth port_dist canyon_dist sst wind fuel oxygen fault_km", digits=8,
    sql=f"""SELECT c.cell_id, m.year_month, lbs, dens, depth, port_dist, canyon_dist, CASE WHEN mid - obs_day <= 60 THEN sst END AS sst, wind, fuel, oxygen, n_faults, fault_km, coalesce(is_open, false) AS is_open
        FROM (SELECT DISTINCT cell_id FROM pings) c, (SELECT DISTINCT strftime(date, '%Y_%m') AS year_month, CAST(date_trunc('month', date) AS DATE) + 14 AS mid FROM pings) m
        LEFT JOIN (SELECT cell_id AS ec, year_month AS em, sum(lbs) AS lbs, sum(pings) >= 3 AS is_open FROM effort GROUP BY 1, 2) ON ec = c.cell_id AND em = m.year_month
        LEFT JOIN (SELECT cell_id AS sc, year_month AS sm, dens, 1 - occ AS oxygen FROM species) ON sc = c.cell_id AND sm = m.year_month
        LEFT JOIN (SELECT cell_id AS gc, depth, gx AS cgx, gy AS cgy FROM grid) ON gc = c.cell_id
        LEFT JOIN (SELECT cell_id AS pc, min(sqrt((gx - px) ** 2 + (gy - py) ** 2)) AS port_dist FROM grid, ports GROUP BY 1) ON pc = c.cell_id
        LEFT JOIN (SELECT g.cell_id AS kc, min(sqrt((g.gx - k.gx) ** 2 + (g.gy - k.gy) ** 2)) AS canyon_dist FROM grid g, grid k WHERE k.depth < -180 GROUP BY 1) ON kc = c.cell_id
        ASOF LEFT JOIN (SELECT cell_id AS oc, obs_day, sst FROM soundings) ON oc = c.cell_id AND obs_day <= mid
        LEFT JOIN (SELECT user_id % 12 + 1 AS wm, median(value) AS wind FROM events GROUP BY 1) ON wm = {_MONTH_OF}
        LEFT JOIN (SELECT month(ts) AS fm, avg(value) AS fuel FROM events GROUP BY 1) ON fm = {_MONTH_OF}
        LEFT JOIN (SELECT cx + 10 AS fx, cy + 10 AS fy, count(*) AS n_faults, sum(length) / 1000 AS fault_km FROM ({PIECES.format(size="1000e0", lines="lines")}) GROUP BY 1, 2) ON fx = cgx AND fy = cgy""",
)
def covariate_table(t):
    """Effort, prediction, depth, distances to port and canyon, last sea temperature of 60 days, wind, fuel price, oxygen, faults and closure on one spine."""
    p = t.pings.withColumn("year_month", cal.year_month("date"))
    full = spine(p.select("cell_id"), p.select("year_month")).withColumn("month", F.substring("year_month", 6, 2).cast("int"))
    at = lambda df, x, y, *more: df.select(*more, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = at(t.grid, "gx", "gy", "cell_id")
    canyon = at(t.grid.where("depth < -180"), "gx", "gy", F.col("cell_id").alias("canyon"))
    to = lambda other, key, name: nearest(cells, other, ["cell_id"], key).select("cell_id", F.col("dist").alias(name))
    place = t.grid.select("cell_id", "gx", "gy")
    full = asof_join(full.withColumn("mid", F.date_add(F.to_date("year_month", "yyyy_MM"), 14)), t.soundings, ["cell_id"], "mid", "obs_day", ["sst"], 60).drop("mid", "obs_day")
    cut = cut_lines(t.lines, "x1", "y1", "x2", "y2", 1000.0, (-10000.0, -10000.0))
    faults = cut.groupBy(F.col("cx").alias("gx"), F.col("cy").alias("gy")).agg(F.count(F.lit(1)).alias("n_faults"), (F.sum("length") / 1000).alias("fault_km"))
    events = t.read("events")
    layers = [
        (t.effort.groupBy("cell_id", "year_month").agg(F.sum("lbs").alias("lbs"), (F.sum("pings") >= 3).alias("is_open")), ["cell_id", "year_month"]),
        (t.species.select("cell_id", "year_month", "dens", (1 - F.col("occ")).alias("oxygen")), ["cell_id", "year_month"]),
        (t.grid.select("cell_id", "depth"), ["cell_id"]),
        (to(at(t.ports, "px", "py", "port"), "port", "port_dist"), ["cell_id"]),
        (to(canyon, "canyon", "canyon_dist"), ["cell_id"]),
        (place.join(faults, ["gx", "gy"]).select("cell_id", "n_faults", "fault_km"), ["cell_id"]),
        (exact_quantiles(events.select((F.col("user_id") % 12 + 1).cast("int").alias("month"), "value"), ["month"], "value", {"wind": 0.5}), ["month"]),
        (events.groupBy(F.month("ts").alias("month")).agg(F.avg("value").alias("fuel")), ["month"]),
    ]
    return ft.feature_table(full, layers).drop("month").withColumn("is_open", F.coalesce("is_open", F.lit(False)))


@query(
    "nearest_layer_in_time", "D38", doubles="sst",
    sql="""SELECT ticket_id, landing_date, obs_day, sst FROM (SELECT ticket_id, landing_date, cell, obs_day, sst, row_number() OVER (PARTITION BY ticket_id ORDER BY abs(obs_day - landing_date), obs_day) AS rn
        FROM (SELECT ticket_id, landing_date, ticket_id % 400 AS cell FROM tickets) LEFT JOIN soundings ON cell_id = cell AND abs(obs_day - landing_date) <= 20) WHERE rn = 1""",
)
def nearest_layer_in_time(t):
    """Each landing with the observation at its place that is nearest in time, none older or younger than 20 days."""
    l = t.tickets.select("ticket_id", "landing_date", (F.col("ticket_id") % 400).alias("cell_id"))
    return asof_join(l, t.soundings, ["cell_id"], "landing_date", "obs_day", ["sst"], 20, "nearest").drop("cell_id")


@query(
    "inflation_adjusted_revenue", "D39", doubles="revenue:3 real_revenue:1",
    sql="""SELECT port, year, revenue, revenue * ((SELECT max(index) FROM cpi WHERE year = 2000) / index) AS real_revenue FROM (SELECT port, year(landing_date) AS year, sum(revenue) AS revenue FROM tickets GROUP BY 1, 2) LEFT JOIN cpi USING (year)""",
)
def inflation_adjusted_revenue(t):
    r = t.tickets.groupBy("port", F.year("landing_date").alias("year")).agg(F.sum("revenue").alias("revenue"))
    return ft.deflate(r, t.cpi, "year", "revenue", 2000, "real_revenue")


@query(
    "port_weighted_price", "D40 A12", doubles="price", digits=6,
    sql="""SELECT cell_id, sum(share * price) AS price FROM (SELECT cell_id, port, sum(lbs) / sum(sum(lbs)) OVER (PARTITION BY cell_id) AS share FROM pings JOIN tickets USING (ticket_id) GROUP BY 1, 2)
        JOIN (SELECT port, sum(revenue) / count(*) / 1000 AS price FROM tickets GROUP BY 1) USING (port) GROUP BY 1""",
)
def port_weighted_price(t):
    j = t.pings.join(t.tickets.select("ticket_id", "port"), "ticket_id")
    price = t.tickets.groupBy("port").agg((F.sum("revenue") / F.count(F.lit(1)) / 1000).alias("price"))
    return ft.port_weighted(j, "cell_id", "port", "lbs", price, "price", "price")


@query(
    "imputed_slices", "D53 R4", doubles="pings",
    sql="""SELECT cell_id, season, slot, coalesce(p, (lag(p) OVER w + lead(p) OVER w) / 2, lag(p) OVER w, lead(p) OVER w) AS pings FROM slot_spine
        LEFT JOIN (SELECT cell_id, crab_year AS season, (month(date) + 1) % 12 + 1 AS slot, CAST(sum(pings) AS DOUBLE) AS p FROM effort GROUP BY 1, 2, 3) USING (cell_id, season, slot)
        WINDOW w AS (PARTITION BY cell_id, season ORDER BY slot)""",
)
def imputed_slices(t):
    e = t.effort.groupBy("cell_id", F.col("crab_year").alias("season"), cal.month_of_crab_year("date").alias("slot")).agg(F.sum("pings").cast("double").alias("pings"))
    full = _slot_spine(t, e).join(e, ["cell_id", "season", "slot"], "left")
    return ft.impute_slice(full, ["cell_id", "season"], "slot", "pings")


@query(
    "closure_covariates", "D54 G15", doubles="dist_km",
    sql="""WITH st AS (SELECT s.*, gx, gy FROM slot_status s JOIN grid USING (cell_id)),
        d AS (SELECT o.cell_id, o.season, o.slot, min(sqrt(((o.gx - c.gx) * 5000e0) ** 2 + ((o.gy - c.gy) * 5000e0) ** 2)) / 1000 AS dk FROM st o JOIN st c ON o.season = c.season AND o.slot = c.slot WHERE o.is_open AND NOT c.is_open GROUP BY 1, 2, 3)
        SELECT p.cell_id, p.season, p.slot, is_open, CASE WHEN is_open AND dk IS NULL THEN 700 ELSE dk END AS dist_km, p.cell_id >= 200 AS in_state_waters,
        p.cell_id >= 200 AND p.slot >= 9 AS reduced, CASE WHEN is_open THEN p.slot - min(p.slot) FILTER (is_open) OVER (PARTITION BY p.cell_id, p.season) + 1 END AS slot_since_open
        FROM slot_spine p LEFT JOIN slot_status USING (cell_id, season, slot) LEFT JOIN d USING (cell_id, season, slot)""",
)
def closure_covariates(t):
    status = staged(_status(t))
    keys = ["cell_id", "season", "slot"]
    s = status.join(t.grid.select("cell_id", (F.col("gx") * 5000.0).alias("x"), (F.col("gy") * 5000.0).alias("y")), "cell_id")
    cut = lambda is_open: s.where(F.col("is_open") == is_open).select(*keys, "x", "y")
    dist = distance_to_nearest(cut(True), cut(False), "cell_id", ["season", "slot"]).drop("closed_id")
    in_state = F.col("cell_id") >= 200
    return ft.closure_features(_slot_spine(t, status), status, dist, keys, 700.0, in_state, F.col("slot") >= 9)


@query(
    "revenue_per_set", "D41 W9",
    sql="""SELECT ticket_id, cell_id, lbs, revenue * (lbs / sum(lbs) OVER (PARTITION BY ticket_id)) AS set_revenue FROM pings JOIN (SELECT ticket_id, sum(revenue) AS revenue FROM tickets GROUP BY 1) USING (ticket_id)""",
)
def revenue_per_set(t):
    return ft.revenue_per_set(t.tickets, t.pings.select("ticket_id", "cell_id", "lbs"), "ticket_id", "revenue", "lbs").select("ticket_id", "cell_id", "lbs", "set_revenue")


@query(
    "vessel_revenue", "D42", doubles="total mean median", digits=4,
    sql="""SELECT year, month, count(*) AS n_vessels, sum(rev) AS total, avg(rev) AS mean, median(rev) AS median FROM (SELECT year(landing_date) AS year, month(landing_date) AS month, vessel_id, sum(revenue) AS rev FROM tickets GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def vessel_revenue(t):
    k = t.tickets.withColumns({"year": F.year("landing_date"), "month": F.month("landing_date")})
    return ft.vessel_revenue(k, "vessel_id", ["year", "month"], "revenue")


_PORTS = range(6)


@query(
    "vessel_movement_matrix", "D47 R7",
    sql=f"""WITH l AS (SELECT DISTINCT vessel_id, c_custkey % 6 AS x, landing_date, (ticket_id + vessel_id) % 6 AS port FROM tickets JOIN customer ON vessel_id = c_custkey),
        c AS (SELECT DISTINCT CAST(n_nationkey % 6 AS BIGINT) AS home, DATE '1998-01-01' + CAST((n_nationkey % 6) * 30 AS INT) AS a, DATE '1998-07-01' + CAST((n_nationkey % 6) * 30 AS INT) AS b FROM nation),
        m AS (SELECT DISTINCT vessel_id, home, a, b FROM l JOIN c ON l.port = c.home WHERE landing_date < a),
        d AS (SELECT DISTINCT m.vessel_id, home, port FROM m JOIN l USING (vessel_id) WHERE landing_date BETWEEN a AND b)
        SELECT home, """ + ", ".join(f"count(*) FILTER (port = {i}) AS p{i}" for i in _PORTS) + " FROM d GROUP BY 1",
)
def vessel_movement_matrix(t):
    l = t.tickets.select("vessel_id", "landing_date", ((F.col("ticket_id") + F.col("vessel_id")) % 6).alias("port"))
    h = (F.col("n_nationkey") % 6).cast("long")
    day = lambda d: F.date_add(F.lit(d).cast("date"), (h * 30).cast("int"))
    closed = t.read("nation").select(h.alias("home"), day("1998-01-01").alias("closed_from"), day("1998-07-01").alias("closed_to")).distinct()
    m = ft.movement_matrix(l, "vessel_id", "port", "landing_date", closed, _PORTS)
    return m.withColumnsRenamed({str(i): f"p{i}" for i in _PORTS})


@query(
    "share_outside_domain", "D48", doubles="total outside share_outside",
    sql=f"""SELECT crab_year, sum(lbs) AS total, sum(lbs) FILTER (depth <= -150) AS outside, sum(lbs) FILTER (depth <= -150) / sum(lbs) AS share_outside FROM effort GROUP BY 1""",
)
def share_outside_domain(t):
    return ft.share_outside(t.effort, t.grid.where("depth > -150"), "cell_id", ["crab_year"], "lbs")


@query(
    "participation_response", "D50", doubles="pct_dropped pct_moved",
    sql=f"""WITH a AS (SELECT DISTINCT vessel_id, ticket_id % 3 AS port, {crab_year_sql('landing_date')} AS season FROM tickets), h AS (SELECT vessel_id, port AS home FROM a WHERE season = '1996_1997'),
        n AS (SELECT count(DISTINCT vessel_id) AS n_base FROM h)
        SELECT season, n_active, n_moved, n_base, 100.0 * (n_base - n_active) / n_base AS pct_dropped, 100.0 * n_moved / n_base AS pct_moved FROM (
        SELECT season, count(*) AS n_active, count_if(same = 0) AS n_moved FROM (SELECT season, a.vessel_id, max((port = home)::INT) AS same FROM a JOIN h USING (vessel_id) GROUP BY 1, 2) GROUP BY 1), n""",
)
def participation_response(t):
    a = t.tickets.select("vessel_id", (F.col("ticket_id") % 3).alias("port"), cal.crab_year("landing_date").alias("season"))
    return ft.participation_response(a, "vessel_id", "port", "season", "1996_1997")


@query(
    "residual_summary", "D51", doubles="mean_residual median_residual", digits=7,
    sql="""SELECT region, bia, count(r) AS n, avg(r) AS mean_residual, median(r) AS median_residual FROM (SELECT region, bia, avg_lbs - lbs AS r FROM effort JOIN (SELECT cell_id, round(avg(lbs), 6) AS avg_lbs FROM effort GROUP BY 1) USING (cell_id)) GROUP BY 1, 2""",
)
def residual_summary(t):
    m = t.effort.groupBy("cell_id").agg(F.round(F.avg("lbs"), 6).alias("avg_lbs"))
    return ft.residual_summary(t.effort.join(m, "cell_id"), ["region", "bia"], "lbs", "avg_lbs")


@query(
    "trimmed_outliers", "D56 A4", doubles="lbs", digits=6,
    sql="""SELECT cell_id, date, lbs FROM effort JOIN (SELECT region, quantile_cont(lbs, 0.95) AS cut FROM (SELECT region, lbs FROM effort WHERE lbs <= 120) GROUP BY 1) USING (region)
        WHERE lbs <= 120 AND lbs <= cut AND cell_id NOT IN (SELECT cell_id FROM grid WHERE depth < -180)""",
)
def trimmed_outliers(t):
    e = t.effort.select("cell_id", "date", "region", "lbs")
    return ft.trim(e, "lbs", largest=120.0, q=0.95, keys=["region"], drop_keys=t.grid.where("depth < -180").select("cell_id"), drop_on=["cell_id"]).select("cell_id", "date", "lbs")


@query(
    "vessel_season_catch_rate", "D42 A10", doubles="cpue", digits=7,
    sql=f"""SELECT crab_year, pre_post, count(*) AS n_trips, sum(lbs) / sum(n) AS cpue FROM (SELECT {crab_year_sql('date')} AS crab_year, CASE WHEN date < DATE '1998-11-01' THEN 'pre' ELSE 'post' END AS pre_post, ticket_id, sum(lbs) AS lbs, count(*) AS n FROM pings GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def vessel_season_catch_rate(t):
    p = t.pings.select("ticket_id", "lbs", F.lit(1).alias("pots"), cal.crab_year("date").alias("crab_year"), F.when(F.col("date") < F.lit("1998-11-01").cast("date"), "pre").otherwise("post").alias("pre_post"))
    from ..operators.aggs import ratio_of_sums

    r = ratio_of_sums(p, ["ticket_id", "crab_year", "pre_post"], ["crab_year", "pre_post"], "lbs", "pots", "cpue")
    return r.select("crab_year", "pre_post", F.col("n_units").alias("n_trips"), "cpue")

"""How the domain tables are derived from the given tables, in Spark and in SQL alike.

The grid has 400 cells by construction (a key modulo 400), which is the size
bound behind its broadcast hint.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.geometry import point
from ..functions.polygons import rings_from_wkt
from ..functions.scalars import region_of
from ..plans import effort as eff
from ..plans.risk import normalized_species
from ..session import staged

CELLS = 400
SIDE = 20


# Corners about a port: outline and second part counter-clockwise, hole clockwise.
OUTLINE = ((-3.0137, -2.7211), (3.3319, -2.4073), (0.2171, 3.6413))
HOLE = ((-0.9157, -1.1231), (0.1097, 0.9371), (1.1173, -1.3019))
APART = ((4.1291, 1.2167), (6.3413, 1.4319), (5.2271, 3.1153))
# Corners of source polygons as (x, share of x by key, y): counter-clockwise with a notch, the hole clockwise.
NOTCHED = ((-1.1, -0.01, -0.9), (1.3, 0.0, -1.0), (0.9, 0.03, 1.2), (0.1, 0.0, 0.2), (-0.8, 0.0, 1.4))
NOTCHED_HOLE = ((-0.3, 0.0, -0.5), (0.1, 0.0, -0.1), (0.4, 0.0, -0.6))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pings(self) -> DataFrame:
        li = self.read("lineitem").select(
            F.col("l_orderkey").alias("ticket_id"), (F.col("l_partkey") % CELLS).alias("cell_id"),
            F.col("l_quantity").alias("lbs"), F.col("l_extendedprice").alias("rev"),
        )
        o = self.read("orders").select(
            F.col("o_orderkey").alias("ticket_id"), F.col("o_custkey").alias("vessel_id"),
            F.col("o_orderdate").cast("date").alias("date"),
        )
        return li.join(o, "ticket_id")

    @cached_property
    def tickets(self) -> DataFrame:
        o = self.read("orders")
        c = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("port"))
        return o.join(c, "o_custkey").select(
            F.col("o_orderkey").alias("ticket_id"), F.col("o_custkey").alias("vessel_id"),
            F.col("o_orderdate").cast("date").alias("landing_date"), "port",
            F.col("o_totalprice").alias("revenue"), F.col("o_orderpriority").alias("removal"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        c = F.col("cell_id")
        g = self.read("part").select((F.col("p_partkey") % CELLS).alias("cell_id")).distinct()
        g = g.select(
            c, (c % SIDE).alias("gx"), F.floor(c / SIDE).alias("gy"),
            (32.6 + 0.85 * F.floor(c / SIDE)).alias("lat"), (-126.0 + 0.25 * (c % SIDE)).alias("lon"),
            (25 - c % 5).cast("double").alias("area"), (-((c * 7) % 200)).cast("double").alias("depth"),
            (c % 7 == 0).alias("bia"),
        )
        return F.broadcast(g.withColumn("region", region_of("lat")))

    @cached_property
    def effort(self) -> DataFrame:
        daily = eff.effort_daily(self.pings)
        return daily.join(self.grid.select("cell_id", "region", "depth", "bia", "area"), "cell_id")

    @cached_property
    def species(self) -> DataFrame:
        li = self.read("lineitem")
        s = li.groupBy((F.col("l_partkey") % CELLS).alias("cell_id"), cal.year_month("l_shipdate").alias("year_month")).agg(
            F.round(F.avg("l_discount"), 10).alias("occ"), F.round(F.avg("l_tax"), 10).alias("dens")
        )
        # Staged, because the normalisation needs its ranges and queries read it several times.
        return normalized_species(staged(s), {"occ": "n_occ", "dens": "n_dens"})

    @cached_property
    def permits(self) -> DataFrame:
        k = F.col("c_custkey")
        begin = F.date_add(F.lit("1995-01-01").cast("date"), ((k * 37) % 1500).cast("int"))
        return self.read("customer").select(
            k.alias("vessel_id"), begin.alias("begin_date"), F.date_add(begin, 365).alias("end_date"),
            F.when(k % 3 == 0, 500).when(k % 3 == 1, 300).otherwise(200).alias("pot_limit"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        e = lambda i: F.col("embedding")[i].cast("double") * 10000.0
        k = F.col("vec_id")
        return self.read("embeddings").select(
            k.alias("set_id"), F.col("label").cast("long").alias("vessel"), (1 + k % 20).alias("pots"),
            F.date_add(F.lit("2009-12-01").cast("date"), ((k * 13) % 3000).cast("int")).alias("set_date"),
            F.when(F.col("label") % 2 == 0, 500).otherwise(300).alias("pot_limit"),
            e(0).alias("x1"), e(1).alias("y1"), e(2).alias("x2"), e(3).alias("y2"),
        )

    @cached_property
    def bathymetry(self) -> DataFrame:
        """Depth in decimetres per 500 m raster cell over a 40 x 40 window; port cells hold a sentinel."""
        p = self.read("orders").select((F.col("o_orderkey") % 1600).alias("k")).distinct()
        k = F.col("k")
        return p.select(
            (k % 40 - 20).alias("ix"), (F.floor(k / 40) - 20).alias("iy"),
            F.when(k % 97 == 0, -100000.0).otherwise(-((k * 37) % 2500).cast("double")).alias("depth"),
        )

    @cached_property
    def events(self) -> DataFrame:
        o = self.read("orders").where("o_orderpriority = '1-URGENT'")
        c = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        names = F.array(*[F.lit(r) for r in ("CenCA", "NorCA", "OR", "WA")])
        return o.join(c, "o_custkey").select(
            F.col("o_orderkey").alias("case_id"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month_start"),
            F.element_at(names, (F.col("c_nationkey") % 4 + 1).cast("int")).alias("region"),
        )

    @cached_property
    def ocean(self) -> DataFrame:
        return self.read("events").select(
            "event_id", F.col("ts").cast("date").alias("day"), (F.col("user_id") % SIDE).alias("sx"),
            (F.col("event_id") % SIDE).alias("sy"), "value",
        )

    @cached_property
    def soundings(self) -> DataFrame:
        """Dated observations at the 400 places."""
        k = F.col("event_id")
        return self.read("events").select(
            (k * 7 % CELLS).alias("cell_id"), F.date_add(F.lit("1994-06-01").cast("date"), (k * 7919 % 1500).cast("int")).alias("obs_day"), "value",
        ).groupBy("cell_id", "obs_day").agg(F.round(F.avg("value"), 8).alias("sst"))

    @cached_property
    def ports(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.read("nation").select(k.alias("port"), ((k * 3) % 20).alias("px"), ((k * 11) % 20).alias("py"), "n_regionkey")

    @cached_property
    def zones(self) -> DataFrame:
        """A triangle around each port."""
        x, y = F.col("px") * 1.0, F.col("py") * 1.0
        ring = F.array(point(x - 1.2, y - 1.1), point(x + 1.7, y - 0.3), point(x + 0.2, y + 1.9))
        return self.ports.select("port", ring.alias("ring"))

    @cached_property
    def waters(self) -> DataFrame:
        """A triangle with a triangular hole around each port, and a second part apart from it, as a layer lands them in text."""
        corner = lambda p: F.concat_ws(" ", (F.col("px") + p[0]).cast("string"), (F.col("py") + p[1]).cast("string"))
        ring = lambda ps: F.concat(F.lit("("), F.concat_ws(", ", *[corner(p) for p in (*ps, ps[0])]), F.lit(")"))
        wkt = F.concat(F.lit("MULTIPOLYGON (("), ring(OUTLINE), F.lit(", "), ring(HOLE), F.lit("), ("), ring(APART), F.lit("))"))
        return self.ports.select("port", wkt.alias("wkt")).withColumn("rings", rings_from_wkt("wkt"))

    @cached_property
    def erased(self) -> DataFrame:
        """Notched source polygons, each with a hole, and a value."""
        s = self.read("part").groupBy((F.col("p_partkey") % 150).alias("src")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"))
        x, y, k = (F.col("src") * 7 % 20 + 0.31), (F.col("src") * 11 % 20 + 0.17), F.col("src") % 7
        ring = lambda ps: F.array(*[point(x + a + k * b, y + c) for a, b, c in ps])
        return s.select("src", "value", F.array(ring(NOTCHED), ring(NOTCHED_HOLE)).alias("rings"))

    @cached_property
    def cpi(self) -> DataFrame:
        y = F.year("o_orderdate")
        years = self.read("orders").select(y.alias("year")).distinct()
        return years.select("year", (150 + 5 * (F.col("year") - 1995)).cast("double").alias("index"))

    @cached_property
    def cell_month(self) -> DataFrame:
        """Staged, because quantile queries read it several times; pings are counted without the effort chain."""
        from ..plans.risk import cell_months

        month = cal.year_month("date").alias("year_month")
        monthly = self.pings.groupBy("cell_id", month).agg(F.count(F.lit(1)).alias("pings"))
        return staged(cell_months(monthly.join(self.grid.select("cell_id"), "cell_id", "left_semi"), self.species, self.grid))


def crab_year_sql(d: str) -> str:
    return rollover_sql(d, 11, "_")


def rollover_sql(d: str, first: int, sep: str) -> str:
    return (
        f"CASE WHEN month({d}) >= {first} THEN year({d}) || '{sep}' || (year({d}) + 1) "
        f"ELSE (year({d}) - 1) || '{sep}' || year({d}) END"
    )


def region_sql(lat: str) -> str:
    return (
        f"CASE WHEN {lat} > 32.5 AND {lat} <= 38.833 THEN 'CenCA' WHEN {lat} > 38.833 AND {lat} <= 42 THEN 'NorCA' "
        f"WHEN {lat} > 42 AND {lat} <= 46.25 THEN 'OR' WHEN {lat} > 46.25 AND {lat} <= 50 THEN 'WA' END"
    )


def half_month_sql(d: str) -> str:
    return f"monthname({d}) || '_' || CASE WHEN day({d}) <= 15 THEN 1 ELSE 2 END"


def anchor_sql(month: int, day: int, cy: str = "crab_year") -> str:
    part = f"substr({cy}, 1, 4)" if month >= 11 else f"substr({cy}, 6, 4)"
    return f"make_date(CAST({part} AS INT), {month}, {day})"


CTES: dict[str, str] = {
    "pings": """SELECT l_orderkey AS ticket_id, l_partkey % 400 AS cell_id, l_quantity AS lbs, l_extendedprice AS rev,
        o_custkey AS vessel_id, CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "tickets": """SELECT o_orderkey AS ticket_id, o_custkey AS vessel_id, CAST(o_orderdate AS DATE) AS landing_date,
        c_nationkey AS port, o_totalprice AS revenue, o_orderpriority AS removal FROM orders JOIN customer ON o_custkey = c_custkey""",
    "grid": f"""SELECT *, {region_sql('lat')} AS region FROM (SELECT cell_id, cell_id % 20 AS gx, cell_id // 20 AS gy,
        32.6e0 + 0.85e0 * (cell_id // 20) AS lat, -126e0 + 0.25e0 * (cell_id % 20) AS lon, CAST(25 - cell_id % 5 AS DOUBLE) AS area,
        CAST(-((cell_id * 7) % 200) AS DOUBLE) AS depth, cell_id % 7 = 0 AS bia
        FROM (SELECT DISTINCT p_partkey % 400 AS cell_id FROM part))""",
    "trip_size": "SELECT ticket_id, count(*) AS trip_pings FROM pings GROUP BY 1",
    "effort": f"""SELECT {crab_year_sql('date')} AS crab_year, strftime(date, '%Y_%m') AS year_month, date, p.cell_id, g.region, g.depth, g.bia, g.area,
        sum(lbs) AS lbs, sum(rev) AS rev, count(*) AS pings, sum(1e0 / trip_pings) AS vessel_share, count(DISTINCT vessel_id) AS vessels
        FROM pings p JOIN trip_size USING (ticket_id) JOIN grid g ON p.cell_id = g.cell_id GROUP BY ALL""",
    "species_raw": """SELECT l_partkey % 400 AS cell_id, strftime(l_shipdate, '%Y_%m') AS year_month, round(avg(l_discount), 10) AS occ, round(avg(l_tax), 10) AS dens
        FROM lineitem GROUP BY 1, 2""",
    "species": """SELECT *, (occ - min(occ) OVER ()) / (max(occ) OVER () - min(occ) OVER ()) AS n_occ,
        (dens - min(dens) OVER ()) / (max(dens) OVER () - min(dens) OVER ()) AS n_dens FROM species_raw""",
    "permits": """SELECT c_custkey AS vessel_id, DATE '1995-01-01' + CAST((c_custkey * 37) % 1500 AS INT) AS begin_date,
        DATE '1995-01-01' + CAST((c_custkey * 37) % 1500 AS INT) + 365 AS end_date,
        CASE c_custkey % 3 WHEN 0 THEN 500 WHEN 1 THEN 300 ELSE 200 END AS pot_limit FROM customer""",
    "lines": """SELECT vec_id AS set_id, CAST(label AS BIGINT) AS vessel, 1 + vec_id % 20 AS pots,
        DATE '2009-12-01' + CAST((vec_id * 13) % 3000 AS INT) AS set_date, CASE WHEN label % 2 = 0 THEN 500 ELSE 300 END AS pot_limit,
        CAST(embedding[1] AS DOUBLE) * 10000 AS x1, CAST(embedding[2] AS DOUBLE) * 10000 AS y1,
        CAST(embedding[3] AS DOUBLE) * 10000 AS x2, CAST(embedding[4] AS DOUBLE) * 10000 AS y2 FROM embeddings""",
    "bathymetry": """SELECT k % 40 - 20 AS ix, k // 40 - 20 AS iy, CASE WHEN k % 97 = 0 THEN -100000e0 ELSE CAST(-((k * 37) % 2500) AS DOUBLE) END AS depth
        FROM (SELECT DISTINCT o_orderkey % 1600 AS k FROM orders)""",
    "cases": """SELECT o_orderkey AS case_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
        ['CenCA', 'NorCA', 'OR', 'WA'][c_nationkey % 4 + 1] AS region
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""",
    "ocean": "SELECT event_id, CAST(ts AS DATE) AS day, user_id % 20 AS sx, event_id % 20 AS sy, value FROM events",
    "soundings": """SELECT event_id * 7 % 400 AS cell_id, DATE '1994-06-01' + CAST(event_id * 7919 % 1500 AS INT) AS obs_day, round(avg(value), 8) AS sst FROM events GROUP BY 1, 2""",
    "ports": "SELECT n_nationkey AS port, (n_nationkey * 3) % 20 AS px, (n_nationkey * 11) % 20 AS py, n_regionkey FROM nation",
    "zone_edges": """SELECT port, px - 1.2e0 AS ax, py - 1.1e0 AS ay, px + 1.7e0 AS bx, py - 0.3e0 AS by FROM ports
        UNION ALL SELECT port, px + 1.7e0, py - 0.3e0, px + 0.2e0, py + 1.9e0 FROM ports
        UNION ALL SELECT port, px + 0.2e0, py + 1.9e0, px - 1.2e0, py - 1.1e0 FROM ports""",
    "erased_edges": "SELECT src, value, " + """x + u0 AS ax, y + v0 AS ay, x + u1 AS zx, y + v1 AS zy FROM (
        SELECT p_partkey % 150 AS src, (p_partkey % 150) * 7 % 20 + 0.31e0 AS x, (p_partkey % 150) * 11 % 20 + 0.17e0 AS y, (p_partkey % 150) % 7 AS k, round(avg(p_retailprice), 6) AS value
        FROM part GROUP BY 1, 2, 3, 4) s, LATERAL (""" + " UNION ALL ".join(
        f"SELECT {a[0]}e0 + s.k * {a[1]}e0 AS u0, {a[2]}e0 AS v0, {b[0]}e0 + s.k * {b[1]}e0 AS u1, {b[2]}e0 AS v1"
        for ring in (NOTCHED, NOTCHED_HOLE) for a, b in zip(ring, ring[1:] + ring[:1])) + ") e",
    "cpi": "SELECT DISTINCT year(o_orderdate) AS year, CAST(150 + 5 * (year(o_orderdate) - 1995) AS DOUBLE) AS index FROM orders",
    "cell_month": """SELECT s.cell_id, s.year_month, occ, dens, n_occ, n_dens, CAST(coalesce(e.pings, 0) AS DOUBLE) AS pings,
        dens * coalesce(e.pings, 0) AS risk, g.region, g.area FROM species s
        LEFT JOIN (SELECT cell_id, year_month, sum(pings) AS pings FROM effort GROUP BY 1, 2) e ON s.cell_id = e.cell_id AND s.year_month = e.year_month
        JOIN grid g ON s.cell_id = g.cell_id WHERE s.cell_id IN (SELECT cell_id FROM effort)""",
}

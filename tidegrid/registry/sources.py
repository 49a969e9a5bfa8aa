"""Reads over the given files, and round trips through files written to the shared folder."""

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.polygons import rings_area, rings_from_geojson, rings_from_wkt
from ..operators.spatial import ring_box
from ..session import scratch_path
from ..sources import readers as rd
from ..sources import writers as wr
from .bindings import APART, HOLE, OUTLINE
from .core import query


def _folder(t, name):
    return scratch_path(t.spark, f"{name}-{uuid4().hex}")


@query(
    "typed_csv_round_trip", "S1 S9", doubles="c_acctbal", digits=2,
    sql="SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal FROM customer",
)
def typed_csv_round_trip(t):
    path = _folder(t, "csv")
    balance = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal")
    wr.write_csv(t.read("customer").select("c_custkey", "c_name", "c_nationkey", balance), path)
    return rd.read_typed_csv(t.spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double")


@query("exported_sheet_read", "S4", sql="SELECT n_nationkey, n_name FROM nation")
def exported_sheet_read(t):
    """A sheet with heading rows between the data, as spreadsheets export it."""
    path = _folder(t, "sheet")
    rows = t.read("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    heads = t.read("region").select(F.lit(None).cast("int").alias("n_nationkey"), F.concat(F.lit("Region "), "r_name").alias("n_name"))
    wr.write_csv(rows.unionByName(heads), path)
    return rd.read_exported_sheet(t.spark, path, "n_nationkey int, n_name string", "n_nationkey")


@query(
    "stage_table_round_trip", "S10", doubles="total", digits=2,
    sql="SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1",
)
def stage_table_round_trip(t):
    o = t.read("orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    return wr.write_stage(o, _folder(t, "stage"), ["year"]).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("typed_table_read", "S2", sql="SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def typed_table_read(t):
    return rd.read_table(t.spark, f"{t.sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tagged_file_union", "S3 U2",
    sql="""SELECT source, n_nationkey, n_name, r_regionkey, r_name FROM (
        SELECT 'nation' AS source, n_nationkey, n_name, NULL::INT AS r_regionkey, NULL AS r_name FROM nation
        UNION ALL SELECT 'region', NULL, NULL, r_regionkey, r_name FROM region)""",
)
def tagged_file_union(t):
    paths = [f"{t.sf_dir}/nation.parquet", f"{t.sf_dir}/region.parquet"]
    return rd.read_tagged_files(t.spark, paths, r"(\w+)\.parquet", "source").select("source", "n_nationkey", "n_name", "r_regionkey", "r_name")


@query(
    "yearly_backfill", "S8", doubles="total",
    sql="SELECT year(o_orderdate) AS year, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1", digits=2,
)
def yearly_backfill(t):
    o = rd.backfill_by_year(t.spark, f"{t.sf_dir}/orders.parquet", [1996, 1998], date_column="o_orderdate")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query(
    "incremental_backfill", "S8 S10", doubles="total", digits=2,
    sql="""SELECT y.year, y.year > 1996 AS fetched_late, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) AS total FROM range(1995, 1999) y(year) LEFT JOIN orders ON year(o_orderdate) = y.year
        AND (y.year <> 1997 OR o_orderpriority <> '5-LOW') GROUP BY 1, 2 HAVING count(o_orderkey) > 0""",
)
def incremental_backfill(t):
    """Two runs of a backfill: the second fetches only the years that the first left out; then one year's partition is replaced."""
    path = scratch_path(t.spark, f"backfill-{uuid4().hex}")
    first, late = set(), set()

    def fetch(seen):
        def year(y):
            seen.add(y)
            return rd.backfill_by_year(t.spark, f"{t.sf_dir}/orders.parquet", [y], date_column="o_orderdate").select("o_orderkey", "o_orderpriority", "o_totalprice")
        return year

    rd.fill_years(t.spark, path, [1995, 1996], fetch(first))
    rd.fill_years(t.spark, path, range(1995, 1999), fetch(late))
    orders = rd.read_filled(t.spark, path)
    wr.refresh_partitions(orders.where("year = 1997 AND o_orderpriority <> '5-LOW'"), f"{path}/rows", ["year"])
    return rd.read_filled(t.spark, path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")).withColumn("fetched_late", F.col("year").isin(sorted(late - first)))


@query(
    "grid_field_slice", "S6", doubles="value",
    sql="""SELECT sx AS ix, sy AS iy, day AS t, avg(value) AS value FROM ocean WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' GROUP BY 1, 2, 3""",
)
def grid_field_slice(t):
    path = f"{t.sf_dir}/events.parquet"
    kind = t.spark.read.parquet(path).schema["ts"].dataType
    times = [F.lit(x).cast(kind) for x in ("2024-01-03 00:00:00", "2024-01-12 23:59:59.999999")]
    o = rd.read_grid_cells(t.spark, path, times, "ts")
    cell = lambda c, n: (F.col(c) % 20).alias(n)
    return o.groupBy(cell("user_id", "ix"), cell("event_id", "iy"), F.col("ts").cast("date").alias("t")).agg(F.avg("value").alias("value"))


@query(
    "polygon_layer", "S5", doubles="x0 y0 x1 y1",
    sql="""SELECT port, 4 AS n_corners, px - 1e0 AS x0, py - 1e0 AS y0, px + 1e0 AS x1, py + 2e0 AS y1 FROM ports""",
)
def polygon_layer(t):
    """Outlines as well-known text in a column, as a vector layer lands them."""
    p = t.ports
    corner = lambda x, y: F.concat_ws(" ", (F.col("px") + x).cast("string"), (F.col("py") + y).cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[corner(*c) for c in ((-1, -1), (1, -1), (1, 2), (-1, 2), (-1, -1))]), F.lit("))"))
    ring = ring_box(p.withColumn("wkt", wkt).withColumn("ring", rd.ring_from_wkt("wkt")), "ring")
    return ring.select("port", F.size("ring").alias("n_corners"), "x0", "y0", "x1", "y1")


def _triangle_sql(ps):
    (ax, ay), (bx, by), (cx, cy) = ps
    return f"abs(({bx}e0 - {ax}e0) * ({cy}e0 - {ay}e0) - ({cx}e0 - {ax}e0) * ({by}e0 - {ay}e0)) / 2"


@query(
    "polygon_layer_parts", "S5", doubles="area json_area far_x", digits=6,
    sql=f"""SELECT port, 3 AS n_rings, 9 AS n_corners, {_triangle_sql(OUTLINE)} - {_triangle_sql(HOLE)} + {_triangle_sql(APART)} AS area,
        {_triangle_sql(OUTLINE)} - {_triangle_sql(HOLE)} + {_triangle_sql(APART)} AS json_area, px + {APART[1][0]}e0 AS far_x, true AS open_ring_is_null FROM ports""",
)
def polygon_layer_parts(t):
    """Polygons with a hole and a second part, from well-known text and from GeoJSON coordinates."""
    w = t.waters
    closed = F.transform("rings", lambda r: F.concat(F.transform(r, lambda p: F.array(p["x"], p["y"])), F.array(F.array(r[0]["x"], r[0]["y"]))))
    text = F.to_json(F.array(F.slice(closed, 1, 2), F.slice(closed, 3, 1)))
    w = w.withColumns({"json": rings_from_geojson(F.lit("MultiPolygon"), text), "broken": rings_from_wkt(F.regexp_replace("wkt", r", [^,]*\)\)\)$", ")))"))})
    return w.select(
        "port", F.size("rings").alias("n_rings"), F.size(F.flatten("json")).alias("n_corners"), rings_area("rings").alias("area"), rings_area("json").alias("json_area"),
        F.array_max(F.transform(F.flatten("rings"), lambda p: p["x"])).alias("far_x"), F.col("broken").isNull().alias("open_ring_is_null"),
    )


_REG = ["CenCA", "NorCA", "OR", "WA"]


@query(
    "wide_region_export", "S11 R3", doubles="CenCA_pings NorCA_pings OR_pings WA_pings CenCA_rev NorCA_rev OR_rev WA_rev", digits=3,
    sql="SELECT year_month, " + ", ".join(
        f"CAST(sum(pings) FILTER (region = '{r}') AS DOUBLE) AS \"{r}_pings\", sum(rev) FILTER (region = '{r}') AS \"{r}_rev\"" for r in _REG
    ) + " FROM effort GROUP BY 1",
)
def wide_region_export(t):
    return wr.export_wide(
        t.effort, ["year_month"], "region", _REG, {"pings": F.sum("pings").cast("double"), "rev": F.sum("rev")}
    )


@query(
    "gridded_export", "S12", doubles="lbs lat lon", digits=4,
    sql="""SELECT e.cell_id, lbs, lat, lon, gx, gy FROM (SELECT cell_id, sum(lbs) AS lbs FROM pings GROUP BY 1) e LEFT JOIN grid USING (cell_id)""",
)
def gridded_export(t):
    g = t.pings.groupBy("cell_id").agg(F.sum("lbs").alias("lbs"))
    return wr.attach_cells(g, t.grid, "cell_id", ["lat", "lon", "gx", "gy"])

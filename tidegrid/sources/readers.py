"""Sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.polygons import RINGS, rings_from_geojson, rings_from_wkt


def read_typed_csv(spark: SparkSession, path, schema, **options) -> DataFrame:
    """CSV with fixed types; nothing is inferred, so codes such as ``1009-1`` stay text."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_tagged_files(spark: SparkSession, paths, pattern: str, tag: str, fmt: str = "parquet", **options) -> DataFrame:
    """Files of differing layout, tagged from their names, united with missing columns as null."""
    parts = [
        spark.read.format(fmt).options(**options).load(p).withColumn(
            tag, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
        )
        for p in paths
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_exported_sheet(spark: SparkSession, path: str, schema, skip_blank: str | None = None) -> DataFrame:
    """A spreadsheet landed as CSV; rows without the key column are layout and dropped."""
    df = read_typed_csv(spark, path, schema)
    return df if skip_blank is None else df.where(F.col(skip_blank).isNotNull())


def _only_ring(rings):
    """The ring of a polygon that has just one, else null."""
    return F.when(F.size(rings) == 1, rings[0])


def ring_from_wkt(c: str):
    """The ring of a polygon in well-known text as array<struct<x,y>> without the closing point; null if it has holes or parts."""
    return _only_ring(rings_from_wkt(c))


def read_polygons(spark: SparkSession, path: str, fmt: str = "wkt", schema: str = "id string, wkt string", strict: bool = False) -> DataFrame:
    """Polygon layer landed as CSV with WKT, or as line-delimited GeoJSON features.

    ``rings`` holds all rings of all parts; ``ring`` is filled for polygons of a single ring. A malformed outline gives null
    rings, or with ``strict`` an error that shows it.
    """
    if fmt == "wkt":
        df = read_typed_csv(spark, path, schema, quote='"')
        df = df.withColumns({"rings": rings_from_wkt("wkt"), "_raw": F.col("wkt")}).drop("wkt")
    else:
        f = spark.read.schema("type string, properties map<string,string>, geometry struct<type:string, coordinates:string>").json(path)
        rings = rings_from_geojson("geometry.type", "geometry.coordinates")
        df = f.where("type = 'Feature'").select("properties", rings.alias("rings"), F.col("geometry.coordinates").alias("_raw"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("malformed outline: "), F.substring(F.coalesce("_raw", F.lit("none")), 1, 200)))
        df = df.withColumn("rings", F.when(F.col("rings").isNull(), wrong.cast(RINGS)).otherwise(F.col("rings")))
    return df.withColumn("ring", _only_ring(F.col("rings"))).drop("_raw")


def read_grid_cells(spark: SparkSession, path: str, times=None, time_column: str = "t") -> DataFrame:
    """Gridded field landed as Parquet, one row per cell and time; a time range reaches the scan."""
    df = spark.read.parquet(path)
    return df if times is None else df.where(F.col(time_column).between(*times))


def read_jdbc_filtered(spark: SparkSession, url: str, table: str, columns, predicate: str, **options) -> DataFrame:
    """Database table; selection and projection are pushed into the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(predicate).select(*columns)


def backfill_by_year(spark: SparkSession, path: str, years, year_column: str = "year", date_column: str | None = None) -> DataFrame:
    """Landed rows of the asked years: by the year's partitions, or by ranges of a date column, which reach the scan."""
    df = spark.read.parquet(path)
    if date_column is None:
        return df.where(F.col(year_column).isin(list(years)))
    kind = df.schema[date_column].dataType
    start = lambda y: F.lit(f"{y}-01-01").cast(kind)
    ranges = [(F.col(date_column) >= start(y)) & (F.col(date_column) < start(y + 1)) for y in years]
    return df.where(reduce(lambda a, b: a | b, ranges))


FILLED = "year int, n_rows long"


def filled_years(spark: SparkSession, path: str) -> DataFrame:
    """Years that a table filled by :func:`fill_years` holds whole, with their numbers of rows."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_filled")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        return spark.createDataFrame([], FILLED)
    return spark.read.schema(FILLED).json(f"{path}/_filled").groupBy("year").agg(F.max("n_rows").alias("n_rows"))


def fill_years(spark: SparkSession, path: str, years, fetch, again=()) -> list[int]:
    """Fill a table by year from a source that is asked year by year; gives the years that were fetched.

    ``fetch(year)`` returns the year's rows. A year that the table holds whole is not fetched, unless it is in ``again``. A
    year's rows replace its partition, and only then the year is noted as filled: a run that breaks off leaves at
    most a partition that :func:`read_filled` does not show and that the next run replaces.
    """
    done = {r["year"] for r in filled_years(spark, path).collect()} - set(again)
    todo = [y for y in sorted(set(years)) if y not in done]
    for y in todo:
        rows = fetch(y).withColumn("year", F.lit(y).cast("int"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{path}/rows")
        held = spark.read.schema(rows.schema).parquet(f"{path}/rows").where(F.col("year") == y).count()
        spark.createDataFrame([(y, held)], FILLED).coalesce(1).write.mode("append").json(f"{path}/_filled")
    return todo


def read_filled(spark: SparkSession, path: str, years=None) -> DataFrame:
    """Rows of the years that are filled; others, and half-written ones, are not read."""
    known = [r["year"] for r in filled_years(spark, path).collect()]
    wanted = known if years is None else [y for y in years if y in known]
    if not known:
        raise FileNotFoundError(f"no year is filled in {path}")
    return spark.read.parquet(f"{path}/rows").where(F.col("year").isin(wanted))

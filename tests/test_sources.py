"""File round trips that the registered queries cannot show."""

import json
import pytest
from pyspark.sql import functions as F
from tidegrid.session import ensure_checkpoint_dir, staged
from tidegrid.sources import readers as rd
from tidegrid.sources import writers as wr


def test_typed_csv_keeps_codes_as_text(spark, tmp_path):
    (tmp_path / "log.csv").write_text("page,pots,day\n1009-1,50,2010-01-03\n1010-2,,2010-01-04\n")
    df = rd.read_typed_csv(spark, str(tmp_path / "log.csv"), "page string, pots int, day date")
    assert [(r.page, r.pots) for r in df.orderBy("page").collect()] == [("1009-1", 50), ("1010-2", None)]
    sheet = rd.read_exported_sheet(spark, str(tmp_path / "log.csv"), "page string, pots int, day date", "pots")
    assert sheet.count() == 1


def test_tagged_files_of_different_layout(spark, tmp_path):
    (tmp_path / "logs_2009-2010.csv").write_text("a,b\n1,2\n")
    (tmp_path / "logs_2010-2011.csv").write_text("a,c\n3,4\n")
    paths = sorted(str(p) for p in tmp_path.glob("*.csv"))
    df = rd.read_tagged_files(spark, paths, r"logs_([0-9-]+)\.csv", "season", "csv", header=True)
    got = sorted((r.season, r.a, r.b, r.c) for r in df.collect())
    assert got == [("2009-2010", "1", "2", None), ("2010-2011", "3", None, "4")]


def test_polygons_from_wkt_and_geojson(spark, tmp_path):
    (tmp_path / "z.csv").write_text('id,wkt\nz1,"POLYGON ((0 0, 2 0, 2 2, 0 0))"\n')
    ring = rd.read_polygons(spark, str(tmp_path / "z.csv")).first().ring
    assert [(p.x, p.y) for p in ring] == [(0, 0), (2, 0), (2, 2)]
    f = {"type": "Feature", "properties": {"id": "z2"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    (tmp_path / "z.json").write_text(json.dumps(f) + "\n")
    row = rd.read_polygons(spark, str(tmp_path / "z.json"), "geojson").first()
    assert row.properties["id"] == "z2" and len(row.ring) == 3


def test_stage_table_is_partitioned_and_pruned(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, 2010).otherwise(2011).alias("year"))
    back = wr.write_stage(df, str(tmp_path / "stage"), ["year"])
    assert back.count() == 100
    late = rd.backfill_by_year(spark, str(tmp_path / "stage"), [2011])
    assert late.count() == 10
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(year" in plan or "year#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_csv_and_feature_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    wr.write_csv(df, str(tmp_path / "out"))
    assert rd.read_typed_csv(spark, str(tmp_path / "out"), "a int, b string").count() == 2
    cells = spark.sql("SELECT 1 AS cell_id, array(named_struct('x', 0D, 'y', 0D)) AS ring")
    wr.write_features(cells, str(tmp_path / "cells"))
    assert spark.read.json(str(tmp_path / "cells")).first().cell_id == 1


def test_grid_cells_time_slice(spark, tmp_path):
    spark.sql("SELECT id AS ix, id AS iy, cast(id as int) AS t, 1.0D AS value FROM range(10)").write.parquet(str(tmp_path / "g"))
    assert rd.read_grid_cells(spark, str(tmp_path / "g"), (2, 4)).count() == 3


def test_cluster_without_shared_folder_is_refused():
    import types

    import pytest

    sc = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(cluster)


def test_years_by_date_range_reach_the_scan(spark, tmp_path):
    spark.sql("SELECT date_add(DATE '1995-01-01', cast(id as int)) AS d, id FROM range(2000)").write.parquet(str(tmp_path / "y"))
    got = rd.backfill_by_year(spark, str(tmp_path / "y"), [1996, 1998], date_column="d")
    assert got.count() == 366 + 365
    assert "GreaterThanOrEqual(d,1996-01-01)" in got._jdf.queryExecution().executedPlan().toString()


def test_staged_frames_are_reliable_checkpoints(spark):
    ensure_checkpoint_dir(spark)
    df = staged(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir() is not None


def test_years_are_filled_once(spark, tmp_path):
    """A filled year is not fetched again, a run that breaks off leaves no half year, and the next run repairs it."""
    path, asked = str(tmp_path / "filled"), []

    def fetch(y):
        asked.append(y)
        if y == 2003 and asked.count(2003) == 1:
            return spark.range(10).select(F.col("id"), F.when(F.col("id") == 7, F.raise_error(F.lit("line broke"))).otherwise(F.lit("x")).alias("v"))
        return spark.range(y - 2000).select("id", F.lit(f"{y}").alias("v"))

    assert rd.fill_years(spark, path, [2002, 2001], fetch) == [2001, 2002]
    with pytest.raises(Exception, match="line broke"):
        rd.fill_years(spark, path, [2001, 2002, 2003, 2004], fetch)
    assert asked == [2001, 2002, 2003]
    # Even rows that a broken run may have left behind are not shown.
    spark.range(3).select("id", F.lit("half").alias("v"), F.lit(2003).alias("year")).write.mode("append").partitionBy("year").parquet(f"{path}/rows")
    assert {r.year for r in rd.read_filled(spark, path).collect()} == {2001, 2002}
    assert rd.fill_years(spark, path, [2001, 2002, 2003, 2004], fetch) == [2003, 2004] and asked[3:] == [2003, 2004]
    rows = rd.read_filled(spark, path).groupBy("year").agg(F.count("v").alias("n"), F.max("v").alias("v")).collect()
    assert {(r.year, r.n, r.v) for r in rows} == {(y, y - 2000, str(y)) for y in (2001, 2002, 2003, 2004)}
    assert rd.fill_years(spark, path, [2001, 2004], fetch, again=[2004]) == [2004]
    plan = rd.read_filled(spark, path, [2004])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2004" in plan


def test_refresh_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "stage")
    wr.write_stage(spark.sql("SELECT 1 AS k, 'a' AS v UNION ALL SELECT 2, 'b'"), path, ["k"])
    wr.refresh_partitions(spark.sql("SELECT 'c' AS v, 2 AS k UNION ALL SELECT 'd', 3"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]

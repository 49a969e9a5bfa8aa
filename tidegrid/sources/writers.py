"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reshape import pivot_values


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_stage(df: DataFrame, path: str, keys=(), mode: str = "overwrite") -> DataFrame:
    """Write a stage table partitioned by its coarse keys and return it as read back.

    Rows are rebalanced by the partition keys: adaptive execution merges small keys and deals a key with most of the
    rows over as many tasks as its size asks for.
    """
    keys = list(keys)
    out = df.hint("rebalance", *keys) if keys else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def refresh_partitions(df: DataFrame, path: str, keys) -> None:
    """Replace the partitions of a stage table that ``df`` has rows for; all others stay as they are."""
    keys = list(keys)
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def export_wide(df: DataFrame, keys, pivot_col: str, values, aggs: dict[str, Column]) -> DataFrame:
    """One row per key and one column per pivot value, ready to be written."""
    return pivot_values(df, keys, pivot_col, values, aggs)


def attach_cells(df: DataFrame, grid: DataFrame, cell_id: str, columns) -> DataFrame:
    """Add cell geometry and attributes for export."""
    return df.join(grid.select(cell_id, *columns), cell_id, "left")


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Line-delimited JSON; rings are written as arrays of points."""
    df.write.mode(mode).json(path)

"""Wide to long, long to wide, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import spine


def dated_columns_to_long(df: DataFrame, ids, value: str, pattern: str = r"(\d{4}).(\d{2}).(\d{2})") -> DataFrame:
    """Columns whose names hold a date become rows of (ids, date, value)."""
    cols = [c for c in df.columns if c not in ids]
    long = df.unpivot(list(ids), cols, "_name", value)
    parts = [F.regexp_extract("_name", pattern, i).try_cast("int") for i in (1, 2, 3)]
    return long.select(*ids, F.make_date(*parts).alias("date"), value)


def listed(column: str, values) -> Column:
    """The column's value, which must be null or one of ``values``: a pivot would drop others without a word."""
    c = F.col(column)
    wrong = F.raise_error(F.concat(F.lit(f"{column} has a value that is not listed: "), c.cast("string")))
    return F.when(c.isNull() | c.isin(list(values)), c).otherwise(wrong)


def pivot_values(df: DataFrame, keys, on: str, values, aggs: dict[str, Column]) -> DataFrame:
    """Long to wide with the value list always given, so no extra job finds it; a value not listed is an error."""
    df = df.withColumn(on, listed(on, values))
    return df.groupBy(*keys).pivot(on, list(values)).agg(*[c.alias(n) for n, c in aggs.items()])


def complete(df: DataFrame, keys, dim: DataFrame, fill: dict) -> DataFrame:
    """Every key with every value of a dimension; missing measures filled."""
    full = spine(df.select(*keys), dim)
    return full.join(df, [*keys, *dim.columns], "left").fillna(fill)


def complete_years(df: DataFrame, keys, year: str, fill: dict) -> DataFrame:
    """Fill the year sequence between each group's first and last year."""
    g = df.groupBy(*keys).agg(F.min(year).alias("_a"), F.max(year).alias("_b"))
    full = g.select(*keys, F.explode(F.sequence("_a", "_b")).alias(year))
    return full.join(df, [*keys, year], "left").fillna(fill)


def transition_matrix(df: DataFrame, unit: str, origin: str, dest: str, values) -> DataFrame:
    """From-by-to table of distinct units."""
    pairs = df.select(unit, origin, dest).distinct().withColumn(dest, listed(dest, values))
    return pairs.groupBy(origin).pivot(dest, list(values)).agg(F.count(F.lit(1))).fillna(0)

"""Ranks, lags, running totals and rescaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import col, safe_divide
from .skew import attach_totals, running_counts, value_counts


def rank_columns(df: DataFrame, group, measures: dict[str, str], tiebreak) -> DataFrame:
    """Ascending row-number ranks of several measures within a group.

    For result tables (scenarios by year or period), whose groups are as small as the
    scenario list.
    """
    out = {}
    for name, measure in measures.items():
        w = Window.partitionBy(*group).orderBy(F.col(measure), *tiebreak)
        out[name] = F.row_number().over(w)
    return df.withColumns(out)


def rank_sorted(df: DataFrame, group, order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def lag_difference(df: DataFrame, group, order, cols: dict[str, str], default: float = 0.0) -> DataFrame:
    """Difference from the previous row of the group; the first row differs from ``default``."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({n: F.col(c) - F.lag(c, 1, default).over(w) for n, c in cols.items()})


def percent_change(df: DataFrame, group, order, cols: dict[str, str]) -> DataFrame:
    """Percent change from the previous row of the group; null for the first or a zero base."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = {}
    for n, c in cols.items():
        prev = F.lag(c).over(w)
        out[n] = 100 * safe_divide(F.col(c) - prev, prev)
    return df.withColumns(out)


def lag_columns(df: DataFrame, group, order, value: str, lags) -> DataFrame:
    """Values n steps back; run on a completed spine so that a step is a calendar step."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({f"{value}_lag{n}": F.lag(value, n).over(w) for n in lags})


def running_percent(df: DataFrame, keys, value: str) -> DataFrame:
    """Count per distinct value with running count and percent of the group total."""
    r = running_counts(value_counts(df, keys, value), keys, value, ["n"])
    return r.select(
        *keys, value, "n", F.col("n_upto").alias("running_n"),
        (100.0 * F.col("n_upto") / F.col("n_all")).alias("running_pct"),
    )


def empirical_cdf(df: DataFrame, keys, value: str, out: str = "ecdf") -> DataFrame:
    """Share of the group's rows with a value at or below the row's own; repeated on each row."""
    r = running_counts(value_counts(df, keys, value), keys, value, ["n"])
    cdf = r.select(*keys, value, (F.col("n_upto") / F.col("n_all")).alias(out))
    return df.join(cdf, [*keys, value])


def season_counter(df: DataFrame, group, order, flag: Column, name: str) -> DataFrame:
    """Counter that steps up at each flagged row; for calendar-length tables."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(flag.cast("int")).over(w))


def rescale_min_max(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """To 0..1 over the table or within groups; 0.5 where all values are equal."""
    t = attach_totals(df, keys, {"_lo": F.min(value), "_hi": F.max(value)})
    span = F.col("_hi") - F.col("_lo")
    return t.withColumn(
        out, F.when(F.col(value).isNull(), None).when(span == 0, 0.5).otherwise((F.col(value) - F.col("_lo")) / span)
    ).drop("_lo", "_hi")


def z_score(df: DataFrame, keys, value: str, out: str, n_sd: float = 1.0) -> DataFrame:
    """Centre and divide by ``n_sd`` sample standard deviations; null for a constant group."""
    t = attach_totals(df, keys, {"_m": F.avg(value), "_s": F.stddev_samp(value)})
    return t.withColumn(out, safe_divide(F.col(value) - F.col("_m"), n_sd * F.col("_s"))).drop("_m", "_s")


def ends_of_group(df: DataFrame, keys, order) -> DataFrame:
    """First and last row of each group as two structs, without sorting the group."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    s = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min(s).alias("first_row"), F.max(s).alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


def every_nth(df: DataFrame, keys, order: str, n: int) -> DataFrame:
    """Every n-th row of a group by a numeric order that is unique in the group, also for hot groups."""
    numbered = running_counts(value_counts(df, keys, order), keys, order, ["n"])
    keep = numbered.where(F.col("n_upto") % n == 0).select(*keys, order)
    return df.join(keep, [*keys, order], "left_semi")


def group_size_is(df: DataFrame, keys, size: int) -> DataFrame:
    """Rows of groups with exactly ``size`` rows."""
    return attach_totals(df, keys, {"_n": F.count(F.lit(1))}).where(F.col("_n") == size).drop("_n")


def top_fraction(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Rows in the top fraction by value, cut at an exact rank with ties kept together."""
    r = running_counts(value_counts(df, [], value), [], value, ["n"])
    above = F.col("n_all") - F.col("n_upto")
    keep = r.where(above < F.col("n_all") * fraction).select(value)
    return df.join(keep, value, "left_semi")

"""Grouped aggregates."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import col, sum_or_zero
from .skew import attach_totals, exact_quantiles


def sum_metrics(df: DataFrame, keys, cols) -> DataFrame:
    return df.groupBy(*keys).agg(*[sum_or_zero(c).alias(c) for c in cols])


def summary_stats(df: DataFrame, keys, value: str) -> DataFrame:
    """n, mean, median, sd, min and max per group."""
    keys = list(keys)
    basic = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return basic.join(exact_quantiles(df, keys, value, {"median": 0.5}), keys, "left")


def quantiles_wide(df: DataFrame, keys, value: str, qs) -> DataFrame:
    return exact_quantiles(df, keys, value, {f"q{round(q * 1000):04d}": q for q in qs})


def quantiles_long(df: DataFrame, keys, value: str, qs) -> DataFrame:
    wide = quantiles_wide(df, keys, value, qs)
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), names, "quantile", "value")


def sum_distinct_by(df: DataFrame, keys, unit: str, value: str, out: str) -> DataFrame:
    """Sum a value once per distinct unit, for example the area of distinct cells."""
    once = df.groupBy(*keys, unit).agg(F.max(value).alias(value))
    return once.groupBy(*keys).agg(F.sum(value).alias(out), F.count(F.lit(1)).alias(f"n_{unit}"))


def ratio_of_sums(df: DataFrame, unit_keys, group_keys, num: str, den: str, out: str) -> DataFrame:
    """Collapse to one row per unit (for example a ticket), then ratio of the group's sums."""
    unit = df.groupBy(*unit_keys).agg(F.sum(num).alias(num), F.sum(den).alias(den))
    g = unit.groupBy(*group_keys).agg(F.sum(num).alias(num), F.sum(den).alias(den), F.count(F.lit(1)).alias("n_units"))
    return g.withColumn(out, F.when(F.col(den) != 0, F.col(num) / F.col(den)))


def share_of_total(df: DataFrame, keys, within, value: str, out: str = "share") -> DataFrame:
    """Group sums and their share of the total of the coarser key ``within``."""
    g = df.groupBy(*keys).agg(F.sum(value).alias(value))
    return attach_totals(g, within, {"_t": F.sum(value)}).withColumn(out, F.col(value) / F.col("_t")).drop("_t")


def weighted_by_share(shares: DataFrame, values: DataFrame, on, keys, share: str, value: str, out: str) -> DataFrame:
    """Sum of share times value per key."""
    return shares.join(values, list(on)).groupBy(*keys).agg(F.sum(F.col(share) * F.col(value)).alias(out))


def text_list(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Sorted distinct values as one text; distinct first so that only distinct values move."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), ", ").alias(out)
    )


def functional_dep_breaks(df: DataFrame, key, value: str) -> DataFrame:
    """Keys with more than one value, null counted as a value."""
    pairs = df.select(*key, value).distinct()
    return pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def require_functional_dep(df: DataFrame, key, value: str) -> DataFrame:
    bad = functional_dep_breaks(df, key, value).limit(5).collect()
    if bad:
        raise ValueError(f"{value} is not unique per {key}: {bad}")
    return df


def metric_ranges(df: DataFrame, cols) -> DataFrame:
    """One row per metric with its smallest and largest value, from one pass."""
    one = df.agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.col(f"lo_{c}").cast("double").alias("lo"),
                F.col(f"hi_{c}").cast("double").alias("hi"),
            )
            for c in cols
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def null_profile(df: DataFrame, cols=None) -> DataFrame:
    """Null count per column, long form, from one pass."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "n_null")


def duplicate_profile(df: DataFrame, keys) -> DataFrame:
    """How many keys have more than one row, and their percentage."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_multi"),
        (100.0 * F.count_if(F.col("n") > 1) / F.count(F.lit(1))).alias("pct_multi"),
    )


def max_pots(df: DataFrame, keys, licence: str, limit: str, out: str = "max_pots") -> DataFrame:
    """Lines in the water: distinct licences per pot limit times the limit, summed."""
    lic = df.groupBy(*keys, limit).agg(F.countDistinct(licence).alias("n_licences"))
    return lic.groupBy(*keys).agg(
        F.sum("n_licences").alias("n_licences"), F.sum(F.col("n_licences") * F.col(limit)).alias(out)
    )


def two_stage_mean_sum(df: DataFrame, unit_keys, mean_keys, sum_keys, out: str) -> DataFrame:
    """Count per unit, mean of the counts per middle key, sum of the means per outer key."""
    per_unit = df.groupBy(*unit_keys).agg(F.count(F.lit(1)).alias("_n"))
    per_mid = per_unit.groupBy(*mean_keys).agg(F.avg("_n").alias("_m"))
    return per_mid.groupBy(*sum_keys).agg(F.sum("_m").alias(out))


def rate_table(df: DataFrame, keys, exposures: dict[str, float]) -> DataFrame:
    """Events per unit of exposure, for several exposures."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"))
    return g.withColumns({n: F.col("n_events") / F.lit(float(v)) for n, v in exposures.items()})


def t_central(t: float, dof: int) -> float:
    """Probability that a Student t value lies between -t and t, by the finite sum for whole degrees of freedom."""
    theta = math.atan(t / math.sqrt(dof))
    sin, cos2 = math.sin(theta), math.cos(theta) ** 2
    term = total = math.cos(theta) if dof % 2 else 1.0
    for k in range(3 if dof % 2 else 2, dof, 2):
        term *= cos2 * (k - 1) / k
        total += term
    if dof % 2 == 0:
        return sin * total
    return 2 / math.pi * (theta + (sin * total if dof > 1 else 0.0))


@lru_cache(maxsize=None)
def t_quantile(p: float, dof: int) -> float:
    """Student t quantile, 0.5 < p < 1, by bisection between bounds that are widened until they hold it."""
    lo, hi = 0.0, 1.0
    while t_central(hi, dof) < 2 * p - 1:
        lo, hi = hi, 2 * hi
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_central(mid, dof) < 2 * p - 1 else (lo, mid)
    return (lo + hi) / 2


def t_factor(level: float, dof: Column, table: int = 60) -> Column:
    """t quantile of a two-sided interval for any degrees of freedom, 1 or more.

    Exact values up to ``table``; beyond, the expansion of the quantile in 1 / dof around the normal one,
    whose next term is below 1e-8 there.
    """
    p = 0.5 + level / 2
    z = NormalDist().inv_cdf(p)
    # Published terms of the expansion.
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    far = F.lit(z)
    for i, term in enumerate(terms, start=1):
        far = far + term / F.pow(dof.cast("double"), F.lit(float(i)))
    exact = F.array(*[F.lit(t_quantile(p, d)) for d in range(1, table + 1)])
    return F.when(dof <= table, F.get(exact, dof.cast("int") - 1)).otherwise(far)


def mean_ci(df: DataFrame, keys, value: str, level: float = 0.95) -> DataFrame:
    """Mean with a t interval per group; null interval for a single value."""
    g = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    half = F.when(F.col("n") > 1, t_factor(level, F.col("n") - 1) * F.col("sd") / F.sqrt("n"))
    return g.withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half})


def region_and_total(df: DataFrame, keys, region: str, aggs: dict[str, Column], total: str = "All") -> DataFrame:
    """Per region and over all regions in one pass, by grouping sets."""
    keys = list(keys)
    g = df.groupingSets([[*keys, region], keys], *keys, region).agg(
        F.grouping(region).alias("_g"), *[c.alias(n) for n, c in aggs.items()]
    )
    return g.withColumn(region, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(region))).drop("_g")

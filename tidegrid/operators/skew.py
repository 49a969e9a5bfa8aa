"""Group-wise operations that stay distributed when one group holds most rows.

A SQL window moves every row of its partition to one task. These helpers give
the same results by aggregation with map-side combine, so a hot key costs one
partial row per map task, and by running totals over value buckets.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_width


def with_scalars(df: DataFrame, source: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Add whole-table aggregates of ``source`` as columns, through one scalar subquery."""
    one = source.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("s")).scalar()
    return df.withColumn("_one_row", one).select("*", *[F.col("_one_row")[n].alias(n) for n in aggs]).drop("_one_row")


def attach_totals(df: DataFrame, keys, aggs: dict[str, Column], nullable: bool = False) -> DataFrame:
    """Add group aggregates to every row.

    Aggregate and join back instead of a window: the aggregate combines on the
    map side, and adaptive execution splits a hot key on the row side.
    """
    keys = list(keys)
    if not keys:
        return with_scalars(df, df, aggs)
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    if not nullable:
        return df.join(totals, keys)
    t = totals.withColumnsRenamed({k: f"_t_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    return df.join(t, on).drop(*[f"_t_{k}" for k in keys])


def first_per_key(df: DataFrame, keys, order, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``, then by the other columns."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = (F.max if last else F.min)(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, "_r.*").select(*df.columns)


def running_counts(vc: DataFrame, keys, value: str, weights, buckets: int | None = None) -> DataFrame:
    """Running totals of ``weights`` in the order of ``value`` within ``keys``.

    ``vc`` has one row per (keys, value). Values are put into buckets at
    approximate quantiles of the rows; bucket totals give each bucket its start
    and the window only runs inside a bucket. The result does not depend on where the
    bucket bounds lie. Adds ``<w>_upto`` (including this value) and ``<w>_all``.
    """
    keys, weights = list(keys), list(weights)
    n = buckets or shuffle_width(vc.sparkSession)
    # The weights ride along so that this aggregate reads the same shuffle as the main branch.
    points = F.percentile_approx(value, [i / n for i in range(1, n)] or [0.5], 10000)
    # The cuts are in order, so a value is first held against every m-th cut, then against the m after that.
    m = max(1, math.isqrt(n))
    every = F.transform(F.sequence(F.lit(m), F.greatest(F.size("c"), F.lit(m)), F.lit(m)), lambda i: F.get("c", i - 1))
    cuts = vc.agg(points.alias("c"), *[F.sum(w) for w in weights]).select(F.struct("c", every.alias("every"))).scalar()
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col(value)))
    b = (
        vc.withColumns({"_cuts": cuts["c"], "_every": cuts["every"]})
        .withColumn("_k", below("_every") * m)
        .withColumn("_b", F.coalesce(F.col("_k") + below(F.slice("_cuts", F.col("_k") + 1, F.lit(m))), F.lit(0)))  # never null: no null test for the join
        .drop("_cuts", "_every", "_k")
    )
    # One row per (keys, bucket): at most `buckets` rows per window partition.
    per_bucket = b.groupBy(*keys, "_b").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = per_bucket.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_s_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_s_{w}").over(whole).alias(f"{w}_all") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = b.join(starts, [*keys, "_b"])
    return joined.select(
        *[c for c in vc.columns],
        *[(F.sum(w).over(inside) + F.col(f"_o_{w}")).alias(f"{w}_upto") for w in weights],
        *[f"{w}_all" for w in weights],
    )


def value_counts(df: DataFrame, keys, value: str, n: str = "n") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))


def exact_quantiles(df: DataFrame, keys, value: str, qs: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of ``qs``.

    Works on counts per distinct value and bucketed running totals, so no task
    ever holds the values of a whole group.
    """
    keys = list(keys)
    r = running_counts(value_counts(df, keys, value), keys, value, ["n"], buckets)
    first = F.col("n_upto") - F.col("n")
    picks = []
    for name, q in qs.items():
        pos = (F.col("n_all") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        here = lambda k: (first <= k) & (k < F.col("n_upto"))
        picks += [
            F.max(F.when(here(lo), F.col(value).cast("double"))).alias(f"_lo_{name}"),
            F.max(F.when(here(hi), F.col(value).cast("double"))).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_f_{name}"),
        ]
    out = r.groupBy(*keys).agg(*picks)
    return out.select(
        *keys,
        *[
            (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_f_{k}")).alias(k)
            for k in qs
        ],
    )

"""Joins beyond a plain equi-join, each written as an equi-join plus residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import recode
from ..session import staged
from .asof import asof_join
from .skew import running_counts


def left_join_null_safe(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join in which a missing key matches a missing key."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])


def full_join_suffixed(left: DataFrame, right: DataFrame, keys, suffixes=("_x", "_y")) -> DataFrame:
    """Full outer join; columns found on both sides carry a suffix.

    Written as a left join and an anti join, because adaptive execution splits a hot key in those but not in a full join.
    """
    both = [c for c in left.columns if c in right.columns and c not in keys]
    l = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    r = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return full_join(l, r, keys)


def full_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Full outer join of tables that share only their keys, as left join and anti join."""
    alone = right.join(left.select(*keys).distinct(), list(keys), "left_anti")
    return left.join(right, list(keys), "left").unionByName(alone, allowMissingColumns=True)


def replace_columns_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join in which the right table's columns supersede the left's."""
    stale = [c for c in right.columns if c in left.columns and c not in keys]
    return left.drop(*stale).join(right, list(keys), "left")


#: Rows of a dimension that may ride along as one array.
DIMENSION_ROWS = 20_000


def with_dimension(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Every row with every row of a dimension: calendars, class lists, parameter rows.

    The dimension becomes one sorted array from a scalar subquery and is
    exploded, so no row moves and no cross join is planned. Meant for
    dimensions whose size does not depend on the facts: one of more than ``DIMENSION_ROWS`` distinct rows is an error.
    """
    rows = dim.distinct().limit(DIMENSION_ROWS + 1).agg(F.sort_array(F.collect_list(F.struct(*dim.columns))).alias("d"))
    fits = F.when(F.size("d") <= DIMENSION_ROWS, F.col("d")).otherwise(F.raise_error(F.lit(f"a dimension has more than {DIMENSION_ROWS} rows; join it by a key")))
    values = rows.select(fits).scalar()
    return df.withColumn("_d", F.explode(values)).select(*df.columns, "_d.*")


def spine(keys: DataFrame, *dims: DataFrame) -> DataFrame:
    """All combinations of the distinct keys and one or more dimensions."""
    out = keys.distinct()
    for d in dims:
        out = with_dimension(out, d)
    return out


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, begin: str, end: str, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` of the same key whose interval holds ``ts``, both ends included.

    Starts and ends of a key's intervals cut time into segments, numbered in order. An interval covers a run of segments, written as a few
    aligned blocks of one, two, four ... segments; a left row looks into the blocks over its own segment, one of each size that
    its key's segments allow (a single size for a key with one interval). Each pair meets in one block and nothing is compared in vain, however long
    or crowded intervals are; the rows of a busy key are dealt by block. An interval without a start, without an end or with the end before the start
    holds nothing. Times are dates, timestamps or whole numbers, alike on both sides. ``how`` is inner or left.
    """
    number = lambda df, c: _whole_time(F.col(c), df.schema[c].dataType)
    held = right.withColumns({"_lo": number(right, begin), "_hi": number(right, end) + 1}).where(F.col(key).isNotNull() & (F.col("_lo") < F.col("_hi")))
    ends = F.array(F.struct(F.col("_lo").alias("c"), F.lit(1).alias("d")), F.struct(F.col("_hi").alias("c"), F.lit(-1).alias("d")))
    cuts = held.select(key, F.explode(ends).alias("_e")).groupBy(key, F.col("_e.c").alias("_cut")).agg(F.sum("_e.d").alias("_turn"), F.lit(1).alias("_one"))
    numbered = running_counts(cuts, [key], "_cut", ["_one", "_turn"])
    top = F.length(F.bin(F.col("_one_all") - 1)) - 1  # a block is no larger than all segments of its key
    numbered = staged(numbered.select(F.col(key).alias("_k"), "_cut", F.col("_one_upto").cast("long").alias("_seg"), (F.col("_turn_upto") > 0).alias("_open"), top.alias("_top")))
    place = lambda c: numbered.select("_k", F.col("_cut").alias(f"_at{c}"), F.col("_seg").alias(f"_seg{c}"))
    covers = (
        held.join(place("_lo"), (F.col(key) == F.col("_k")) & (F.col("_lo") == F.col("_at_lo"))).drop("_k", "_at_lo")
        .join(place("_hi"), (F.col(key) == F.col("_k")) & (F.col("_hi") == F.col("_at_hi"))).drop("_k", "_at_hi")
        .withColumn("_block", F.explode(_aligned_blocks(F.col("_seg_lo"), F.col("_seg_hi"))))
        .withColumnRenamed(key, "_k").drop("_lo", "_hi", "_seg_lo", "_seg_hi")
    )
    segments = numbered.withColumnRenamed("_k", key)
    l = asof_join(left.withColumn("_now", number(left, ts)), segments, [key], "_now", "_cut", ["_seg", "_open", "_top"]).drop("_now", "_cut")
    over = F.transform(F.sequence(F.lit(0), "_top"), lambda i: F.struct(i.cast("int").alias("level"), F.call_function("shiftright", "_seg", i).alias("node")))
    looked = l.where("_open").withColumn("_block", F.explode(over))
    pairs = looked.join(covers, (F.col(key) == F.col("_k")) & (looked["_block"] == covers["_block"])).drop(looked["_block"]).drop(covers["_block"])
    pairs = pairs.drop("_k", "_seg", "_open", "_top")
    if how == "inner":
        return pairs
    alone = l.where("_open IS NULL OR NOT _open").drop("_seg", "_open", "_top")
    return pairs.unionByName(alone, allowMissingColumns=True)


def _aligned_blocks(first: Column, stop: Column) -> Column:
    """The whole numbers from ``first`` up to before ``stop`` as blocks of 2**level numbers that begin at node * 2**level."""
    block = "array<struct<level:int,node:bigint>>"
    start = F.struct(first.cast("long").alias("a"), stop.cast("long").alias("b"), F.array().cast(block).alias("out"))

    def step(s: Column, level: Column) -> Column:
        odd_a, odd_b = (s["a"] < s["b"]) & (s["a"] % 2 == 1), (s["a"] < s["b"]) & (s["b"] % 2 == 1)
        a, b = s["a"] + odd_a.cast("long"), s["b"] - odd_b.cast("long")
        # Both ends may name the same single block.
        one = lambda when, node: F.when(when, F.array(F.struct(level.cast("int").alias("level"), node.cast("long").alias("node")))).otherwise(F.array().cast(block)).cast(block)
        out = F.concat(s["out"], one(odd_a, s["a"]), one(odd_b & (b >= a), b))
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), out.cast(block).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(stop))), start, step, lambda s: s["out"])


def _whole_time(c: Column, kind) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long")


def range_join(
    left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, left_open: bool = False, how: str = "inner"
) -> DataFrame:
    """Value into bands ``[low, high)`` or ``(low, high]`` through fixed-width buckets."""
    b = lambda c: F.floor(F.col(c) / width)
    l = left.withColumn("_b", b(value))
    r = right.withColumn("_b", F.explode(F.sequence(b(low), b(high))))
    v = F.col(value)
    inside = ((v > F.col(low)) & (v <= F.col(high))) if left_open else ((v >= F.col(low)) & (v < F.col(high)))
    return l.join(r, (l["_b"] == r["_b"]) & inside, how).drop(l["_b"]).drop(r["_b"])


def lookback_join(events: DataFrame, series: DataFrame, keys, month: str, series_month: str, back: int, how="left") -> DataFrame:
    """Each event with the series rows of its month and the ``back`` months before.

    ``month`` and ``series_month`` are first-of-month dates. Adds ``lag_months``.
    """
    lagged = events.withColumn("lag_months", F.explode(F.sequence(F.lit(0), F.lit(back)))).withColumn(
        series_month, F.add_months(F.col(month), -F.col("lag_months")).cast("date")
    )
    return lagged.join(series, [*keys, series_month], how)


def fallback_join(
    df: DataFrame, lookup: DataFrame, key: str, others, value: str, neighbours: dict, defaults: dict | None = None
) -> DataFrame:
    """Look up a value; where it is missing try the neighbour key, then a constant."""
    others = list(others)
    first = df.join(lookup, [key, *others], "left")
    alt = lookup.select(F.col(key).alias("_alt"), *others, F.col(value).alias("_v2"))
    second = first.withColumn("_alt", recode(key, neighbours, keep_other=False)).join(alt, ["_alt", *others], "left")
    filled = F.coalesce(F.col(value), F.col("_v2"))
    if defaults:
        filled = F.coalesce(filled, recode(key, defaults, keep_other=False))
    return second.withColumn(value, filled).drop("_alt", "_v2")


def match_report(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """How many rows of ``left`` find a partner in ``right`` by ``keys``."""
    marked = left.join(right.select(*keys).distinct().withColumn("_hit", F.lit(1)), list(keys), "left")
    return marked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("_hit").alias("n_matched"),
        (F.count("_hit") / F.count(F.lit(1))).alias("match_rate"),
    )


def keep_matching(df: DataFrame, keys_df: DataFrame, keys) -> DataFrame:
    return df.join(keys_df.select(*keys).distinct(), list(keys), "left_semi")


def drop_matching(df: DataFrame, keys_df: DataFrame, keys) -> DataFrame:
    return df.join(keys_df.select(*keys).distinct(), list(keys), "left_anti")


def duplicate_keys(dim: DataFrame, keys) -> DataFrame:
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def join_checked(df: DataFrame, dim: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join to a dimension after checking that its key is unique (runs a job on the dimension)."""
    dup = duplicate_keys(dim, keys).limit(5).collect()
    if dup:
        raise ValueError(f"dimension key {keys} is not unique, e.g. {dup}")
    return df.join(dim, list(keys), how)


def apply_fixes(df: DataFrame, fixes: DataFrame, key, column: str) -> DataFrame:
    """Replace values by a corrections table of (key, new value); others stay."""
    keys = [key] if isinstance(key, str) else list(key)
    f = fixes.select(*keys, F.col(column).alias("_fix"))
    return df.join(f, keys, "left").withColumn(column, F.coalesce("_fix", column)).drop("_fix")

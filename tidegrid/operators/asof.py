"""As-of joins: the last, next or nearest value of a series at each row's time, within a tolerance.

Both sides are put into one sequence per key and the last value is carried along. Times are cut into buckets at quantiles of
all rows, so that a key with most of the rows is worked on in many tasks: the window runs inside a bucket, and
what the buckets before it leave over comes from one row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_width


def _number(df: DataFrame, time: str) -> Column:
    """Time as a number: days of a date, seconds of a timestamp."""
    kind = df.schema[time].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    return F.col(time).cast("double")


def asof_join(left: DataFrame, right: DataFrame, keys, time: str, right_time: str, values, tolerance: float | None = None,
              direction: str = "backward", buckets: int | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the row of ``right`` with equal keys that is due at its ``time``.

    ``direction`` is ``backward`` (last at or before), ``forward`` (first at or after) or ``nearest`` (ties: the earlier).
    ``tolerance`` is the greatest distance in time that counts: days between dates, seconds between timestamps, else plain numbers. Of
    several right rows at one time the one with the greatest values counts. Rows without a key, a time or a partner keep null
    values; ``right_time`` tells when the value was due.
    """
    keys, values = list(keys), list(values)
    due = F.struct(F.col("_t").alias("t"), F.col(right_time).alias(right_time), *values)
    r = right.withColumn("_t", _number(right, right_time)).where(F.col("_t").isNotNull()).dropna(subset=keys)
    r = r.groupBy(*keys, "_t").agg(F.max(due).alias("_due")).withColumns({"_row": F.lit(None).cast(left.schema), "_side": F.lit(0)})
    l = left.select(*keys, _number(left, time).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"))
    both = r.unionByName(l.withColumn("_due", F.lit(None).cast(r.schema["_due"].dataType)))

    n = buckets or shuffle_width(left.sparkSession) * 4
    times = r.select("_t").unionByName(l.select("_t"))
    cuts = times.agg(F.percentile_approx("_t", [i / n for i in range(1, n)] or [0.5], 1000)).scalar()
    b = both.withColumn("_cuts", cuts).withColumn("_b", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))), F.lit(0))).drop("_cuts")

    # At one time the right row comes first for a look back, and last for a look ahead.
    looks = {"backward": ["back"], "forward": ["ahead"], "nearest": ["back", "ahead"]}[direction]
    edges = b.groupBy(*keys, "_b").agg(F.max_by("_due", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"), F.min_by("_due", F.when(F.col("_side") == 0, F.col("_t"))).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_b")
    before = F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    edges = edges.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.col("_b").alias("_eb"), before.alias("_before"), after.alias("_after"))
    inside = Window.partitionBy(*keys, "_b")
    carried = {
        "back": F.last("_due", ignorenulls=True).over(inside.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)),
        "ahead": F.first("_due", ignorenulls=True).over(inside.orderBy("_t", F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)),
    }
    rows = b.withColumns({f"_{k}": carried[k] for k in looks}).where("_side = 1").drop("_due", "_side")
    on = [F.col(k) == F.col(f"_e_{k}") for k in keys] + [F.col("_b") == F.col("_eb")]
    rows = rows.join(edges, on, "left")
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    found = {"back": F.coalesce("_back", "_before") if "back" in looks else None, "ahead": F.coalesce("_ahead", "_after") if "ahead" in looks else None}
    if direction == "nearest":
        rows = rows.withColumns({"_back": found["back"], "_ahead": found["ahead"]})
        later = F.col("_back").isNull() | (F.col("_ahead.t") - F.col("_t") < F.col("_t") - F.col("_back.t"))
        hit = F.when(F.col("_ahead").isNotNull() & later, F.col("_ahead")).otherwise(F.col("_back"))
    else:
        hit = found[looks[0]]
    rows = rows.select("_row", F.when(known, hit).alias("_hit"), "_t")
    if tolerance is not None:
        rows = rows.withColumn("_hit", F.when(F.abs(F.col("_t") - F.col("_hit.t")) <= tolerance, F.col("_hit")))
    return rows.select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in (right_time, *values)])

"""From vessel positions and landing tickets to gridded effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.nulls import in_set, require_columns, safe_divide
from ..operators.skew import attach_totals, with_scalars
from ..session import shuffle_width

METRICS = ["lbs", "rev", "pings", "vessel_share", "vessels"]


def select_trips(
    df: DataFrame, *, agency=None, target=None, removal_types=None, depth_classes=None,
    speed=None, dates=None, months=None,
) -> DataFrame:
    """Fleet filter. Each condition is (column, values or bounds) and reaches the scan.

    ``target`` is ((revenue column, lbs column), value): either may match.
    """
    if agency:
        df = df.where(F.col(agency[0]) == agency[1])
    if target:
        (by_rev, by_lbs), v = target
        df = df.where((F.col(by_rev) == v) | (F.col(by_lbs) == v))
    for rule in (removal_types, depth_classes):
        if rule:
            df = df.where(F.col(rule[0]).isin(list(rule[1])))
    for rule in (speed, dates):
        if rule:
            df = df.where(F.col(rule[0]).between(rule[1], rule[2]))
    if months:  # a function of the date, so this one is tested after the scan
        df = df.where(F.month(months[0]).isin(list(months[1])))
    return df


def clean_tickets(df: DataFrame, keep: dict, drop: dict, positive=()) -> DataFrame:
    """Ticket filter chain: keep listed values, drop listed values, require positive amounts."""
    for c, values in keep.items():
        df = df.where(F.col(c).isin(list(values)))
    for c, values in drop.items():
        df = df.where(~in_set(c, values))
    for c in positive:
        df = df.where(F.col(c) > 0)
    return df


def trip_cells(pings: DataFrame, extra=()) -> DataFrame:
    """Pings pre-aggregated to one row per ticket, vessel, day and cell.

    Everything later works on this grain, so a ticket with a third of all pings
    costs no more rows than it has cells.
    """
    require_columns(pings, ["ticket_id", "vessel_id", "date", "cell_id", "lbs", "rev"])
    return pings.groupBy("ticket_id", "vessel_id", "date", "cell_id", *extra).agg(
        F.sum("lbs").alias("lbs"), F.sum("rev").alias("rev"), F.count(F.lit(1)).alias("pings")
    )


def allocate_trip(pings: DataFrame, tickets: DataFrame, ticket: str, values) -> DataFrame:
    """Ticket totals shared out evenly over the ticket's pings; a ping carries 1/n of a vessel."""
    sized = attach_totals(pings, [ticket], {"trip_pings": F.count(F.lit(1))})
    t = tickets.select(ticket, *[F.col(v).alias(f"_{v}") for v in values])
    out = sized.join(t, ticket)
    return out.withColumns(
        {f"{v}_per_ping": F.col(f"_{v}") / F.col("trip_pings") for v in values}
        | {"vessel_share": 1.0 / F.col("trip_pings")}
    ).drop(*[f"_{v}" for v in values])


def _cell_effort(pings: DataFrame, time: str, bucket: Column, extra) -> DataFrame:
    # Dealt out anew by number: pings often come from a join on the ticket, and joins, aggregates and the window would all run in
    # its few, large tasks. By ticket and cell first, so that a hot ticket is spread until it is reduced to its cells.
    width = shuffle_width(pings.sparkSession)
    trips = trip_cells(pings.repartition(width, "ticket_id", "cell_id"), extra).repartition(width, "ticket_id")
    # A window here is bounded: after pre-aggregation a ticket has at most one row per cell and day.
    sized = trips.withColumn("trip_pings", F.sum("pings").over(Window.partitionBy("ticket_id")))
    keys = [time, "cell_id", *extra]
    by_vessel = sized.withColumn(time, bucket).groupBy(*keys, "vessel_id").agg(
        F.sum("lbs").alias("lbs"),
        F.sum("rev").alias("rev"),
        F.sum("pings").alias("pings"),
        F.sum(F.col("pings") / F.col("trip_pings")).alias("vessel_share"),
    )
    return by_vessel.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("lbs", "rev", "pings", "vessel_share")],
        F.count(F.lit(1)).alias("vessels"),
    )


def effort_daily(pings: DataFrame, extra=()) -> DataFrame:
    """Cell-day effort: lbs, revenue, pings, fractional vessels, unique vessels."""
    return _cell_effort(pings, "date", F.col("date"), extra).withColumns(
        {"crab_year": cal.crab_year("date"), "year_month": cal.year_month("date")}
    )


def effort_monthly(pings: DataFrame, extra=()) -> DataFrame:
    """Cell-month effort; unique vessels are counted over the month."""
    monthly = _cell_effort(pings, "month_start", F.trunc("date", "month").cast("date"), extra)
    return monthly.withColumn("year_month", cal.year_month("month_start")).drop("month_start")


def normalize_floor(df: DataFrame, value: str, out: str, factor: float = 0.5) -> DataFrame:
    """Min-max to 0..1, with exact zeros lifted to ``factor`` times the smallest positive result."""
    scaled = with_scalars(df, df, {"_lo": F.min(value), "_hi": F.max(value)}).withColumn(
        out, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    )
    second = df.where(F.col(value) > df.agg(F.min(value)).scalar())
    lifted = with_scalars(scaled, second, {"_second": F.min(value)})
    floor = (F.col("_second") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return lifted.withColumn(out, F.when(F.col(out) == 0, factor * floor).otherwise(F.col(out))).drop(
        "_lo", "_hi", "_second"
    )


def normalize_to(value: str | Column, lo, hi) -> Column:
    """Position inside an external range; outside values go below 0 or above 1."""
    v = F.col(value) if isinstance(value, str) else value
    return safe_divide(v - lo, F.lit(hi) - lo if not isinstance(hi, Column) else hi - lo)


def suppress(df: DataFrame, keys, vessel: str, values, k: int = 3) -> DataFrame:
    """Group sums with the values of groups of fewer than ``k`` vessels withheld (null)."""
    g = df.groupBy(*keys).agg(F.countDistinct(vessel).alias("n_vessels"), *[F.sum(v).alias(v) for v in values])
    return g.withColumns({v: F.when(F.col("n_vessels") >= k, F.col(v)) for v in values} | {"confidential": F.col("n_vessels") < k})


def suppression_loss(df: DataFrame, keys, within, vessel: str, value: str, k: int = 3) -> DataFrame:
    """Share of groups and of value that suppression withholds."""
    g = df.groupBy(*keys).agg(F.countDistinct(vessel).alias("_nv"), F.sum(value).alias("_v"))
    lost = F.col("_nv") < k
    return g.groupBy(*within).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(lost).alias("n_withheld"),
        (F.coalesce(F.sum(F.when(lost, F.col("_v"))), F.lit(0.0)) / F.sum("_v")).alias("value_withheld"),
    )


def persistence(df: DataFrame, cells: DataFrame, cell_id: str, season: str, width: int = 2) -> DataFrame:
    """Seasons active for every cell of the study area, 0 where never, in classes of ``width`` seasons."""
    g = df.select(cell_id, season).distinct().groupBy(cell_id).agg(F.count(season).alias("n_seasons"))
    full = cells.select(cell_id).distinct().join(g, cell_id, "left").withColumn("n_seasons", F.coalesce("n_seasons", F.lit(0)))
    first = F.floor((F.col("n_seasons") - 1) / width) * width + 1
    label = F.concat(first.cast("string"), F.lit("-"), (first + width - 1).cast("string"))
    return full.withColumn("persistence", F.when(F.col("n_seasons") == 0, "0").otherwise(label))

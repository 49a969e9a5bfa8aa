"""From logbook sets to pot points, trap density and calibrated pot totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.nulls import row_sum
from ..operators.aggs import max_pots
from ..operators.joins import full_join
from ..operators.skew import attach_totals
from ..operators.spatial import assign_cell, line_length, raster_extract, sample_along_line


def compile_logbooks(headers: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Headers and sets by full join, with set dates repaired and a composite set key.

    Needs ``season`` and ``landed`` in the headers, ``set_no`` and ``set_date`` in the sets. Dates whose
    year fits neither year of the season move back by one year.
    """
    j = full_join(headers, sets, [key])
    start = F.substring("season", 1, 4).cast("int")
    return j.withColumn("set_date", cal.repair_year("set_date", start)).withColumn(
        "set_key", F.concat(F.col("season"), F.lit("_"), F.col(key).cast("string"), F.lit("_"), F.col("set_no").cast("string"))
    )


def endpoints_to_lines(points: DataFrame, set_id: str, seq: str, x: str, y: str, carry) -> DataFrame:
    """Two-row sets to one row per line; sets without exactly two endpoints are dropped."""
    ends = points.select(set_id, seq, x, y, *carry).distinct()
    begin = F.min(F.struct(seq, x, y))
    end = F.max(F.struct(seq, x, y))
    g = ends.groupBy(set_id, *carry).agg(begin.alias("_b"), end.alias("_e"), F.count(F.lit(1)).alias("_n"))
    return g.where("_n = 2").select(
        set_id, *carry,
        F.col(f"_b.{x}").alias("x1"), F.col(f"_b.{y}").alias("y1"),
        F.col(f"_e.{x}").alias("x2"), F.col(f"_e.{y}").alias("y2"),
    )


def filter_lines(df: DataFrame, length: str, pots: str, longest: float = 80000.0, zero_pots: int = 50) -> DataFrame:
    """Drop implausibly long lines and lines of no length that claim many pots."""
    return df.where((F.col(length) < longest) & ~((F.col(length) == 0) & (F.col(pots) > zero_pots)))


def filter_depth(df: DataFrame, depth: str, deepest: float = -200.0, port_sentinel: float = -5000.0) -> DataFrame:
    """Keep water between ``deepest`` and 0, and the sentinel depth that marks ports and bays."""
    d = F.col(depth)
    return df.where(((d <= 0) & (d > deepest)) | (d < port_sentinel))


def pots_from_logs(lines: DataFrame, bathymetry: DataFrame, pots: str, cell_size: float, raster_size: float,
                   scale: float = 0.1, origin=(0.0, 0.0), deepest: float = -200.0) -> DataFrame:
    """Lines to pot points with depth and grid cell.

    One row becomes as many rows as the line has pots; nothing is
    shuffled until the depth join.
    """
    measured = lines.withColumn("line_length_m", line_length("x1", "y1", "x2", "y2"))
    good = filter_lines(measured, "line_length_m", pots)
    points = sample_along_line(good, pots, "x1", "y1", "x2", "y2")
    deep = raster_extract(points, bathymetry, "x", "y", raster_size, "depth", scale)
    return assign_cell(filter_depth(deep, "depth", deepest), "x", "y", cell_size, origin)


def reduced_limit(limit: str, reduced: Column) -> Column:
    """Summer rule: 500 pots become 330, any other limit becomes 200."""
    return F.when(reduced, F.when(F.col(limit) == 500, 330).otherwise(200)).otherwise(F.col(limit))


def pot_weights(points: DataFrame, period, vessel: str, limit: str, reduced: Column) -> DataFrame:
    """Weight of a simulated pot: the vessel's lawful pots over its simulated pots in the period.

    Input has one row per pot, or pre-aggregated rows with a count column ``n_pots``.
    """
    p = points if "n_pots" in points.columns else points.withColumn("n_pots", F.lit(1))
    p = p.where(F.col(limit).isNotNull()).withColumn("limit_used", reduced_limit(limit, reduced))
    sized = attach_totals(p, [*period, vessel, limit, "limit_used"], {"vessel_pots": F.sum("n_pots")})
    return sized.withColumn("pot_weight", F.col("limit_used") / F.col("vessel_pots"))


def m1_m2_density(weighted: DataFrame, period, set_id: str, vessel: str, cell_keys, area: float) -> DataFrame:
    """Trap density two ways: mean per set summed over vessels, and pot-limit weighted sum.

    ``weighted`` comes from :func:`pot_weights`, pre-aggregated per set and cell or not.
    """
    period, cell_keys = list(period), list(cell_keys)
    per_set = weighted.groupBy(*period, vessel, set_id, *cell_keys).agg(
        F.sum("n_pots").alias("_n"), F.sum(F.col("n_pots") * F.col("pot_weight")).alias("_w")
    )
    per_vessel = per_set.groupBy(*period, vessel, *cell_keys).agg(F.avg("_n").alias("_m"), F.sum("_w").alias("_w"))
    g = per_vessel.groupBy(*period, *cell_keys).agg(
        F.sum("_m").alias("m1_traps"), F.count(F.lit(1)).alias("n_vessels"), F.sum("_w").alias("m2_traps")
    )
    return g.withColumns({"m1_density": F.col("m1_traps") / area, "m2_density": F.col("m2_traps") / area})


def calibrate_to_tickets(cells: DataFrame, log_limits: DataFrame, ticket_limits: DataFrame, period, licence: str,
                         limit: str, value: str, out: str = "calibrated", reduced: Column | None = None, factor: float = 1.0) -> DataFrame:
    """Scale gridded pots per period by lines in the water from tickets over those from logs.

    Cells for which ``reduced`` holds (a region in listed season months) are multiplied by ``factor`` first, the
    summer reduction; the ratio itself is over unreduced limits.
    """
    if reduced is not None:
        cells = cells.withColumn(value, F.when(reduced, F.col(value) * factor).otherwise(F.col(value).cast("double")))
    logs = max_pots(log_limits, period, licence, limit, "log_pots").drop("n_licences")
    tickets = max_pots(ticket_limits, period, licence, limit, "ticket_pots").drop("n_licences")
    ratio = logs.join(tickets, list(period), "left").withColumn("ratio", F.col("ticket_pots") / F.col("log_pots"))
    return cells.join(ratio, list(period), "left").withColumn(out, F.col(value) * F.col("ratio"))


def expand_sample(df: DataFrame, period, value: str, rate: float, out: str = "expanded") -> DataFrame:
    """Entered share ``rate`` to the whole: the missing total is spread by each row's share."""
    t = attach_totals(df, period, {"_sum": F.sum(value)})
    missing = F.col("_sum") / rate * (1 - rate)
    return t.withColumn(out, F.col(value) + F.col(value) / F.col("_sum") * missing).drop("_sum")


def response_table(spine: DataFrame, sources: dict[str, DataFrame], keys, value: str, out: str) -> DataFrame:
    """Response on the full spine: the sources' values summed, zero where none has any."""
    j = spine
    for name, s in sources.items():
        one = s.groupBy(*keys).agg(F.sum(value).alias(name))
        j = j.join(one, list(keys), "left")
    return j.withColumn(out, row_sum(*sources)).drop(*sources)


def active_licences(df: DataFrame, keys, licence: str, limit: str, pooled: dict) -> DataFrame:
    """Distinct licences per period and pot-limit tier, reduced tiers counted with their full tier."""
    from ..functions.scalars import recode

    return df.withColumn("tier", recode(limit, pooled)).groupBy(*keys, "tier").agg(
        F.countDistinct(licence).alias("n_licences")
    )

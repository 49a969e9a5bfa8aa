"""Covariates, prices, revenue and fleet movement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_divide, sum_or_zero
from ..operators.aggs import weighted_by_share
from ..operators.reshape import listed
from ..operators.skew import attach_totals, exact_quantiles


def feature_table(spine: DataFrame, layers: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Spine with every covariate layer joined by its own keys."""
    return reduce(lambda acc, layer: acc.join(layer[0], layer[1], "left"), layers, spine)


def deflate(df: DataFrame, cpi: DataFrame, year: str, value: str, base_year: int, out: str) -> DataFrame:
    """Money in prices of the base year. ``cpi`` has (year, index)."""
    base = cpi.where(F.col("year") == base_year).agg(F.max("index")).scalar()
    factor = cpi.select(F.col("year").alias(year), (base / F.col("index")).alias("_f"))
    return df.join(factor, year, "left").withColumn(out, F.col(value) * F.col("_f")).drop("_f")


def port_weighted(landings: DataFrame, cell: str, port: str, weight: str, by_port: DataFrame, value: str, out: str) -> DataFrame:
    """Share of each cell's weight that goes to each port, times the port's value, summed."""
    g = landings.groupBy(cell, port).agg(F.sum(weight).alias("_w"))
    shares = attach_totals(g, [cell], {"_t": F.sum("_w")}).withColumn("share", F.col("_w") / F.col("_t"))
    return weighted_by_share(shares, by_port, [port], [cell], "share", value, out)


def impute_slice(df: DataFrame, keys, slot: str, value: str) -> DataFrame:
    """Missing values of a slot: mean of the two adjacent slots, or the one that exists.

    Runs on a completed spine, whose groups are as long as the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(slot)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(value, F.coalesce(F.col(value), (a + b) / 2, a, b))


def closure_features(spine: DataFrame, status: DataFrame, distances: DataFrame, keys, far: float, in_state: Column, reduced: Column) -> DataFrame:
    """Open or closed, distance to the nearest closed cell, state waters, summer rule, slot since opening.

    ``spine`` has cell_id, season and slot; ``status`` has the keys and is_open; a cell open in a slice
    without any closure gets distance ``far``.
    """
    j = spine.join(status, list(keys), "left").join(distances, list(keys), "left")
    opened = F.col("is_open") == True  # noqa: E712
    first = j.where(opened).groupBy("cell_id", "season").agg(F.min("slot").alias("_first"))
    return (
        j.join(first, ["cell_id", "season"], "left")
        .withColumns(
            {
                "dist_km": F.when(opened & F.col("dist_km").isNull(), F.lit(float(far))).otherwise(F.col("dist_km")),
                "in_state_waters": in_state,
                "reduced": F.coalesce(reduced & in_state, F.lit(False)),
                "slot_since_open": F.when(opened, F.col("slot") - F.col("_first") + 1),
            }
        )
        .drop("_first")
    )


def revenue_per_set(tickets: DataFrame, sets: DataFrame, ticket: str, revenue: str, pots: str) -> DataFrame:
    """Ticket rows collapsed, joined to sets; a ticket's revenue is shared by the sets' pots."""
    t = tickets.groupBy(ticket).agg(F.sum(revenue).alias("ticket_revenue"))
    s = attach_totals(sets, [ticket], {"_pots": F.sum(pots)})
    return s.join(t, ticket, "left").withColumn(
        "set_revenue", F.col("ticket_revenue") * safe_divide(F.col(pots), F.col("_pots"))
    ).drop("_pots")


def vessel_revenue(tickets: DataFrame, vessel: str, keys, revenue: str) -> DataFrame:
    """Revenue per vessel and period, with mean, median and vessel count per period."""
    v = tickets.groupBy(*keys, vessel).agg(F.sum(revenue).alias("rev"))
    g = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_vessels"), F.sum("rev").alias("total"), F.avg("rev").alias("mean"))
    return g.join(exact_quantiles(v, keys, "rev", {"median": 0.5}), list(keys))


def movement_matrix(tickets: DataFrame, vessel: str, port: str, date: str, closed: DataFrame, ports) -> DataFrame:
    """Ports used by each closed port's vessels while it was closed: distinct vessels, home by used port.

    ``closed`` has (home, closed_from, closed_to). All ports in one job. A vessel belongs to
    every port it landed in before the closure.
    """
    lands = tickets.select(vessel, F.col(port).alias("used"), date).distinct()
    c = closed.select("home", "closed_from", "closed_to")
    members = (
        lands.withColumnRenamed("used", "home").join(c, "home").where(F.col(date) < F.col("closed_from"))
        .select(vessel, "home").distinct()
    )
    during = (
        members.join(c, "home").join(lands, vessel)
        .where(F.col(date).between(F.col("closed_from"), F.col("closed_to")))
        .select(vessel, "home", "used").distinct()
    )
    during = during.withColumn("used", listed("used", ports))
    return during.groupBy("home").pivot("used", list(ports)).agg(F.count(F.lit(1))).fillna(0)


def share_outside(df: DataFrame, domain: DataFrame, cell: str, keys, value: str) -> DataFrame:
    """Share of a measure that lies in cells outside a model domain."""
    j = df.join(domain.select(cell).distinct().withColumn("_in", F.lit(True)), cell, "left")
    g = j.groupBy(*keys).agg(
        F.sum(value).alias("total"), sum_or_zero(F.when(F.col("_in").isNull(), F.col(value))).alias("outside")
    )
    return g.withColumn("share_outside", safe_divide(F.col("outside"), F.col("total")))


def participation_response(active: DataFrame, vessel: str, port: str, season: str, base: str) -> DataFrame:
    """Per season: vessels of the base season that stayed away, and that landed in other ports only."""
    a = active.select(vessel, port, season).distinct()
    home = a.where(F.col(season) == base).select(vessel, F.col(port).alias("home"))
    n_base = home.agg(F.countDistinct(vessel)).scalar()
    met = a.join(home, vessel).groupBy(season, vessel).agg(F.max((F.col(port) == F.col("home")).cast("int")).alias("_same"))
    g = met.groupBy(season).agg(F.count(F.lit(1)).alias("n_active"), F.count_if(F.col("_same") == 0).alias("n_moved"))
    return g.withColumn("n_base", n_base).withColumns(
        {
            "pct_dropped": 100.0 * (F.col("n_base") - F.col("n_active")) / F.col("n_base"),
            "pct_moved": 100.0 * F.col("n_moved") / F.col("n_base"),
        }
    )


def residual_summary(df: DataFrame, keys, actual: str, predicted: str) -> DataFrame:
    """Median and mean of prediction minus actual per group."""
    d = df.withColumn("_r", F.col(predicted) - F.col(actual))
    g = d.groupBy(*keys).agg(F.count("_r").alias("n"), F.avg("_r").alias("mean_residual"))
    return g.join(exact_quantiles(d, keys, "_r", {"median_residual": 0.5}), list(keys))


def trim(df: DataFrame, value: str, largest: float | None = None, q: float | None = None, keys=(), drop_keys: DataFrame | None = None, drop_on=()) -> DataFrame:
    """Drop outliers above a fixed cut or the group's exact quantile, and listed keys."""
    if largest is not None:
        df = df.where(F.col(value) <= largest)
    if q is not None:
        cut = exact_quantiles(df, keys, value, {"_cut": q})
        df = (df.join(cut, list(keys)) if keys else df.withColumn("_cut", cut.scalar())).where(F.col(value) <= F.col("_cut")).drop("_cut")
    if drop_keys is not None:
        df = df.join(drop_keys, list(drop_on), "left_anti")
    return df

"""Overlap risk: effort times species predictions, summaries, baselines, look-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.nulls import strict_sum, sum_or_zero
from ..operators.joins import lookback_join
from ..operators.skew import exact_quantiles, with_scalars
from .effort import METRICS, normalize_to

RISKS = ["risk_hump", "risk_blue", "n_risk_hump", "n_risk_blue"]


def normalized_species(species: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Min-max of the prediction columns over the whole study area."""
    aggs = {}
    for c in columns:
        aggs[f"_lo_{c}"], aggs[f"_hi_{c}"] = F.min(c), F.max(c)
    s = with_scalars(species, species, aggs)
    return s.withColumns(
        {out: (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c, out in columns.items()}
    ).drop(*aggs)


def risk(
    effort: DataFrame, species: DataFrame, area: DataFrame, metric: str, lo: Column, hi: Column,
    unit: str = "orig", group=(), months: tuple[str, str] | None = None,
) -> DataFrame:
    """Cell-month risk. ``species`` has cell_id, year_month, dens, occ, n_dens, n_occ.

    ``lo`` and ``hi`` are the status-quo range of ``metric``; ``unit='dens'``
    divides by the cell's area; ``months`` bounds year_month.
    """
    if months:
        effort = effort.where(F.col("year_month").between(*months))
    e = effort.groupBy(*group, "year_month", "cell_id", "region").agg(
        *[F.sum(m).alias(m) for m in METRICS], F.first("bia").alias("bia")
    )
    j = e.join(species, ["cell_id", "year_month"], "left").join(area, "cell_id", "left")
    out = j.withColumns({"effort_val": F.col(metric), "n_effort": normalize_to(metric, lo, hi)}).withColumns(
        {
            "risk_hump": F.col("effort_val") * F.col("dens"),
            "risk_blue": F.col("effort_val") * F.col("occ"),
            "n_risk_hump": F.col("n_effort") * F.col("n_dens"),
            "n_risk_blue": F.col("n_effort") * F.col("n_occ"),
        }
    )
    if unit == "dens":
        out = out.withColumns({r: F.col(r) / F.col("area") for r in RISKS})
    return out


def risk_summary(r: DataFrame, level: str = "region", group=()) -> DataFrame:
    """Sums by month and region (or in and out of the protected areas), nulls as zero."""
    g = r.groupBy(*group, "year_month", level).agg(*[sum_or_zero(c).alias(c) for c in [*METRICS, *RISKS]])
    y, m = F.substring("year_month", 1, 4).cast("int"), F.substring("year_month", 6, 2).cast("int")
    return g.withColumn("crab_year", cal.crab_year(F.make_date(y, m, F.lit(1))))


def risk_self_normalised(effort: DataFrame, species: DataFrame, metric: str) -> DataFrame:
    """Risk normalised by the ranges of the joined data itself."""
    e = effort.groupBy("year_month", "cell_id").agg(F.sum(metric).alias("effort_val"))
    j = e.join(species.select("cell_id", "year_month", "dens", "occ"), ["cell_id", "year_month"], "left")
    aggs = {}
    for c in ("effort_val", "dens", "occ"):
        aggs[f"_lo_{c}"], aggs[f"_hi_{c}"] = F.min(c), F.max(c)
    j2 = with_scalars(j, j, aggs)
    unit = lambda c: (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
    return j2.withColumns(
        {"n_risk_hump": unit("effort_val") * unit("dens"), "n_risk_blue": unit("effort_val") * unit("occ")}
    ).drop(*aggs)


def cell_months(monthly: DataFrame, species: DataFrame, grid: DataFrame, fished_only: bool = True) -> DataFrame:
    """Species predictions of cells ever fished, with monthly pings (0 if none) and the product.

    ``monthly`` has one row of pings per cell and month.
    """
    pings = monthly.select("cell_id", "year_month", "pings")
    s = species.join(monthly.select("cell_id").distinct(), "cell_id", "left_semi") if fished_only else species
    return (
        s.join(pings, ["cell_id", "year_month"], "left")
        .withColumn("pings", F.coalesce("pings", F.lit(0)).cast("double"))
        .withColumn("risk", F.col("dens") * F.col("pings"))
        .join(grid.select("cell_id", "region", "area"), "cell_id")
    )


def region_series(df: DataFrame, missing: Column | None = None) -> DataFrame:
    """Region by month: sums, areas and densities over the whole or the observed area.

    Pings and risk are withheld where ``missing``; a single withheld cell makes the region's sum null.
    """
    d = df if missing is None else df.withColumns({c: F.when(~missing, F.col(c)) for c in ("pings", "risk")})
    g = d.groupBy("region", "year_month").agg(
        strict_sum("dens").alias("sum_dens"),
        strict_sum("pings").alias("sum_pings"),
        strict_sum("risk").alias("sum_risk"),
        F.sum("area").alias("area_sum"),
        F.sum(F.when(F.col("dens").isNotNull(), F.col("area"))).alias("area_dens"),
        F.sum(F.when(F.col("risk").isNotNull(), F.col("area"))).alias("area_risk"),
    )
    return g.withColumns(
        {
            "dens_per_area": F.col("sum_dens") / F.col("area_sum"),
            "pings_per_area": F.col("sum_pings") / F.col("area_sum"),
            "risk_per_area": F.col("sum_risk") / F.col("area_sum"),
            "dens_per_seen": F.col("sum_dens") / F.col("area_dens"),
            "risk_per_seen": F.col("sum_risk") / F.col("area_risk"),
        }
    )


def baseline_risk(df: DataFrame, in_base: Column) -> DataFrame:
    """Risk with species, fishing or both held at the mean of the base years, per cell and calendar month."""
    month = F.substring("year_month", 6, 2).cast("int")
    d = df.withColumn("month", month)
    base = (
        d.where(in_base)
        .fillna(0.0, ["dens", "pings"])
        .groupBy("cell_id", "month")
        .agg(F.avg("dens").alias("dens_base"), F.avg("pings").alias("pings_base"))
    )
    return d.join(base, ["cell_id", "month"], "left").withColumns(
        {
            "risk_base_species": F.col("dens_base") * F.col("pings"),
            "risk_base_fishing": F.col("dens") * F.col("pings_base"),
            "risk_base_both": F.col("dens_base") * F.col("pings_base"),
        }
    )


def season_risk_without(series: DataFrame, cut_months, keys=("region", "crab_year")) -> DataFrame:
    """Seasonal risk with months removed, against the whole season: ratio and difference.

    One pass: both sums come from the same aggregate, joined by construction.
    """
    kept = ~F.col("month").isin(list(cut_months))
    g = series.groupBy(*keys).agg(
        sum_or_zero("risk").alias("risk_all"), sum_or_zero(F.when(kept, F.col("risk"))).alias("risk_kept")
    )
    return g.withColumns(
        {
            "risk_ratio": F.when(F.col("risk_all") != 0, F.col("risk_kept") / F.col("risk_all")),
            "risk_diff": F.col("risk_kept") - F.col("risk_all"),
        }
    )


def displace(df: DataFrame, cut_months, to_month: int) -> DataFrame:
    """Move the pings of closed months onto one month's cells, in proportion to its pings.

    Needs cell_id, region, crab_year, month, dens, pings, area. Where the receiving month has no
    pings the effort is spread evenly over its cells. Returns the remaining cell-months.
    """
    cut = F.col("month").isin(list(cut_months))
    season = ["region", "crab_year"]
    totals = df.groupBy(*season).agg(
        sum_or_zero(F.when(cut, F.col("pings"))).alias("_moved"),
        sum_or_zero(F.when(F.col("month") == to_month, F.col("pings"))).alias("_to_sum"),
        F.count_if(F.col("month") == to_month).alias("_to_n"),
    )
    receives = F.col("month") == to_month
    share = F.when(F.col("_to_sum") > 0, F.col("pings") / F.col("_to_sum")).otherwise(1.0 / F.col("_to_n"))
    return (
        df.where(~cut)
        .join(totals, season)
        .withColumn("added", F.when(receives, F.col("_moved") * share).otherwise(F.lit(0.0)))
        .withColumn("pings", F.col("pings") + F.col("added"))
        .withColumn("risk", F.col("dens") * F.col("pings"))
        .drop("_moved", "_to_sum", "_to_n")
    )


def season_risk(df: DataFrame) -> DataFrame:
    """Season risk, area of the distinct cells and risk density per region."""
    cells = df.groupBy("region", "crab_year", "cell_id").agg(
        F.max("area").alias("area"), F.sum("risk").alias("risk"), F.sum("pings").alias("pings")
    )
    g = cells.groupBy("region", "crab_year").agg(
        F.sum("risk").alias("risk"), F.sum("pings").alias("pings"), F.sum("area").alias("area")
    )
    return g.withColumn("risk_per_area", F.col("risk") / F.col("area"))


def lookback_risk(events: DataFrame, series: DataFrame, event_id: str, back: int) -> DataFrame:
    """Largest, total and smallest risk in the months before each event, for 0..``back`` months at once.

    Events have ``region`` and ``month_start``; the series has region, month_start and risk.
    Each lag row counts for every window at least that long, so all windows are one aggregate.
    """
    s = series.select("region", F.col("month_start").alias("series_month"), "risk")
    lagged = lookback_join(events, s, ["region"], "month_start", "series_month", back)
    windows = lagged.withColumn("window_months", F.explode(F.sequence(F.col("lag_months"), F.lit(back))))
    seen = F.when(F.col("risk").isNotNull(), F.struct(F.col("risk"), F.col("series_month")))
    g = windows.groupBy(event_id, "region", "window_months").agg(
        F.max("risk").alias("risk_max"),
        sum_or_zero("risk").alias("risk_sum"),
        F.min("risk").alias("risk_min"),
        F.max_by("series_month", seen).alias("month_of_max"),
    )
    return g


def tag_and_stack(series: DataFrame, linked: DataFrame) -> DataFrame:
    """All values and the event-linked ones, stacked and labelled."""
    return series.withColumn("tag", F.lit("All")).unionByName(
        linked.withColumn("tag", F.lit("Events")), allowMissingColumns=True
    )


def overlap_risk(df: DataFrame, effort: str, species: str) -> Column:
    """No fishing is no risk; fishing without a prediction is unknown."""
    e, s = F.col(effort), F.col(species)
    return F.when(e.isNull() | (e == 0), F.lit(0.0)).when(s.isNull(), F.lit(None)).otherwise(e * s)


def counterfactual_risk(fishing: DataFrame, species: DataFrame, fixed_year: str, fix: str = "species") -> DataFrame:
    """One year's species on every fishing year, or one year's fishing on every species year.

    Both tables have cell_id, month, season and their value (pings, dens).
    """
    if fix == "species":
        fixed = species.where(F.col("season") == fixed_year).drop("season")
        j = fishing.join(fixed, ["cell_id", "month"], "left")
    else:
        fixed = fishing.where(F.col("season") == fixed_year).drop("season")
        j = species.join(fixed, ["cell_id", "month"], "left")
    return j.withColumn("risk", overlap_risk(j, "pings", "dens"))


def hotspots(df: DataFrame, keys, value: str, q: float) -> DataFrame:
    """Flag rows at or above the group's exact quantile."""
    cut = exact_quantiles(df, keys, value, {"threshold": q})
    j = df.join(cut, list(keys)) if keys else df.withColumn("threshold", cut.scalar())
    return j.withColumn("hotspot", F.col(value) >= F.col("threshold"))


def effort_in_hotspots(flagged: DataFrame, effort: DataFrame, on, keys, metric: str) -> DataFrame:
    """Effort inside and outside hot spots, and its share inside."""
    j = effort.join(flagged.select(*on, "hotspot"), list(on), "left")
    inside = F.coalesce(F.col("hotspot"), F.lit(False))
    return j.groupBy(*keys).agg(
        sum_or_zero(F.when(inside, F.col(metric))).alias("inside"),
        sum_or_zero(F.when(~inside, F.col(metric))).alias("outside"),
        F.count_if(inside).alias("n_inside"),
    )


def habitat_class(df: DataFrame, keys, value: str, cuts: dict[str, float]) -> DataFrame:
    """Class each row by the group's exact quantiles; classes named lowest first by ``cuts``."""
    names = list(cuts)
    q = exact_quantiles(df, keys, value, {f"_c{i}": c for i, c in enumerate(cuts.values())})
    j = df.join(q, list(keys))
    cls = F.lit("below")
    for i, n in enumerate(names):
        cls = F.when(F.col(value) >= F.col(f"_c{i}"), F.lit(n)).otherwise(cls)
    return j.withColumn("habitat_class", cls).drop(*[f"_c{i}" for i in range(len(names))])


def aggregate_predictions(df: DataFrame, ids, date: str, value: str, interval: Column, name: str = "interval") -> DataFrame:
    """Mean and standard error of dated predictions per calendar interval.

    The error divides by all values of the interval, missing ones included.
    """
    g = df.withColumn(name, interval).where(F.col(name).isNotNull()).groupBy(*ids, name).agg(
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("_v"),
        F.count(value).alias("n_values"),
        F.count(F.lit(1)).alias("_all"),
    )
    se = F.when(F.col("n_values") > 0, F.sqrt(F.col("_v") * F.col("n_values") / F.col("_all")))
    return g.withColumn("se", se).drop("_v", "_all")


def n_day_interval(date: str, origin: str, n: int) -> Column:
    """Start of the n-day interval (closed left, open right) that holds the date; null before the origin."""
    k = F.floor(F.datediff(F.col(date), F.lit(origin)) / n).cast("int")
    return F.when(k >= 0, F.date_add(F.lit(origin).cast("date"), k * n))


def custom_interval(date: str, bounds) -> Column:
    """Start of the ``[bound, next bound)`` interval that holds the date; null outside."""
    b = [F.lit(x).cast("date") for x in bounds]
    out = None
    for lo, hi in zip(b, b[1:]):
        hit = (F.col(date) >= lo) & (F.col(date) < hi)
        out = F.when(hit, lo) if out is None else out.when(hit, lo)
    return out


def empty_intervals(df: DataFrame, date: str, bounds) -> DataFrame:
    """Custom intervals that hold no date at all."""
    spark = df.sparkSession
    starts = F.array(*[F.lit(x).cast("date") for x in bounds[:-1]])
    have = df.select(custom_interval(date, bounds).alias("interval")).where("interval is not null").distinct()
    return spark.range(1).select(F.explode(starts).alias("interval")).join(have, "interval", "left_anti")


def coverage_report(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on one side only, on both, and keys without any value on the second side."""
    ka = a.select(key).distinct().withColumn("_a", F.lit(1))
    kb = b.groupBy(key).agg(F.count(value).alias("_v"))
    j = ka.join(kb, key, "full")
    return j.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_v").isNotNull()).alias("n_both"),
        F.count_if(F.col("_v").isNull()).alias("n_only_first"),
        F.count_if(F.col("_a").isNull()).alias("n_only_second"),
        F.count_if(F.col("_v") == 0).alias("n_without_value"),
    )

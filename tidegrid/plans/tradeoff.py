"""Trade-offs between risk reduction and value kept, and scenario ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_divide, sum_or_zero
from ..operators.skew import attach_totals
from ..operators.windows import rank_columns, rank_sorted

RISK_COLUMNS = ["risk_hump", "risk_blue", "n_risk_hump", "n_risk_blue"]
VALUE_COLUMNS = ["lbs", "rev", "pings", "vessel_share"]


def annual_totals(summary: DataFrame, group=("scenario",), w_hump: float = 0.5) -> DataFrame:
    """Totals per scenario and crab year; the combined risk is the weighted sum of both species."""
    g = summary.groupBy(*group, "crab_year").agg(
        *[sum_or_zero(c).alias(c) for c in [*VALUE_COLUMNS, *RISK_COLUMNS]]
    )
    both = lambda p: w_hump * F.col(f"{p}_hump") + (1 - w_hump) * F.col(f"{p}_blue")
    return g.withColumns({"risk_both": both("risk"), "n_risk_both": both("n_risk")})


def relative_to_baseline(df: DataFrame, group, is_base: Column, cols, suffix: str = "_base") -> DataFrame:
    """Each group's baseline row values on every row of the group."""
    return attach_totals(df, group, {f"{c}{suffix}": F.max(F.when(is_base, F.col(c))) for c in cols})


def tradeoff(annual: DataFrame, base_name: str, group=("crab_year",)) -> DataFrame:
    """Percent risk reduction and percent of value kept against the status quo."""
    risks = ["risk_hump", "risk_blue", "risk_both", "n_risk_hump", "n_risk_blue", "n_risk_both"]
    kept = ["rev", "lbs"]
    b = relative_to_baseline(annual, group, F.col("scenario") == base_name, [*risks, *kept, "pings"])
    ratio = lambda c: safe_divide(F.col(c), F.col(f"{c}_base"))
    return b.withColumns(
        {f"rel_{c}": 100 * (1 - ratio(c)) for c in [*risks, "pings"]} | {f"rel_{c}": 100 * ratio(c) for c in kept}
    ).drop(*[f"{c}_base" for c in [*risks, *kept, "pings"]])


def benefit_cost(df: DataFrame) -> DataFrame:
    """Risk reduction per percent of revenue lost.

    The cost is 1 when at least 99 percent of revenue is kept; the ratio is 0 when risk rises.
    """
    cost = F.when(F.col("rel_rev") >= 99, F.lit(1.0)).otherwise(100 - F.col("rel_rev"))
    bc = lambda c: F.when(F.col(c) >= 0, F.col(c) / cost).when(F.col(c) < 0, F.lit(0.0))
    return df.withColumns({"bc_hump": bc("rel_n_risk_hump"), "bc_blue": bc("rel_n_risk_blue")})


def rank_scenarios(df: DataFrame, group=("crab_year",)) -> DataFrame:
    """Ascending ranks of the relative measures within a year; ties by scenario name."""
    measures = {
        "rank_hump": "rel_n_risk_hump", "rank_blue": "rel_n_risk_blue", "rank_both": "rel_n_risk_both",
        "rank_rev": "rel_rev", "rank_lbs": "rel_lbs", "rank_bc_hump": "bc_hump", "rank_bc_blue": "bc_blue",
    }
    return rank_columns(df, group, measures, ["scenario"])


def rank_by_period(df: DataFrame, period: Column, digits: int = 10) -> DataFrame:
    """Means per period, ranks within it, and the overall rank by descending risk and value.

    Means are rounded before ranking so that equal results tie whatever the summation order.
    """
    cols = ["n_risk_hump", "rel_n_risk_hump", "n_risk_blue", "rel_n_risk_blue", "n_risk_both", "rel_n_risk_both",
            "rev", "rel_rev", "lbs", "rel_lbs", "bc_hump", "bc_blue"]
    m = df.withColumn("period", period).groupBy("period", "scenario").agg(*[F.round(F.avg(c), digits).alias(c) for c in cols])
    r = rank_scenarios(m, ["period"])
    order = [F.desc(c) for c in ("n_risk_hump", "n_risk_blue", "n_risk_both", "rev", "lbs")] + [F.col("scenario")]
    return rank_sorted(r, ["period"], order, "scenario_rank")


def cost_effectiveness(df: DataFrame, period: Column, base_name: str, qs) -> DataFrame:
    """Quantiles of cost per unit of risk reduction per period and scenario, long form.

    Groups hold one row per year of a period, so the built-in exact percentile fits.
    """
    d = df.where(F.col("scenario") != base_name).withColumns(
        {"period": period, "cost": 100 - F.col("rel_rev")}
    ).withColumns(
        {
            "cost_per_hump": safe_divide(F.col("cost"), F.col("rel_n_risk_hump")),
            "cost_per_blue": safe_divide(F.col("cost"), F.col("rel_n_risk_blue")),
        }
    )
    cols = ["rel_n_risk_hump", "rel_n_risk_blue", "cost", "cost_per_hump", "cost_per_blue"]
    g = d.groupBy("period", "scenario").agg(
        *[F.percentile(c, F.array(*[F.lit(float(q)) for q in qs])).alias(c) for c in cols]
    )
    long = g.select("period", "scenario", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("_i", "quantile"), *cols)
    return long.select("period", "scenario", "quantile", *[F.col(c)[F.col("_i")].alias(c) for c in cols])


def median_rank(quantiles: DataFrame) -> DataFrame:
    """Rank of the medians over the whole table, and the best rank of each scenario."""
    med = quantiles.where("quantile = 0.5")
    r = rank_sorted(med, [], [F.asc_nulls_last("cost_per_hump"), F.asc_nulls_last("cost_per_blue"), F.col("scenario"), F.col("period")], "scenario_rank")
    return attach_totals(r, ["scenario"], {"scenario_min_rank": F.min("scenario_rank")})


def annual_distribution(summary: DataFrame, cols) -> DataFrame:
    """Monthly sums, then the distribution of the months within each crab year."""
    monthly = summary.groupBy("crab_year", "year_month").agg(*[sum_or_zero(c).alias(c) for c in cols])
    return monthly.groupBy("crab_year").agg(
        *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("total", F.sum), ("mean", F.avg), ("median", F.median), ("max", F.max))]
    )


def pre_post_change(df: DataFrame, keys, value: str, is_pre: Column, is_year: Column) -> DataFrame:
    """Mean before the regulation against one year, and the percent change."""
    g = df.groupBy(*keys).agg(
        F.avg(F.when(is_pre, F.col(value))).alias("pre_mean"), F.avg(F.when(is_year, F.col(value))).alias("year_value")
    )
    return g.withColumn("pct_change", 100 * safe_divide(F.col("year_value") - F.col("pre_mean"), F.col("pre_mean")))

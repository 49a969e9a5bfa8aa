"""Statistics on distributed data: correlation, two-sample tests, GLMs, validation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import two_sided_normal
from ..session import staged
from .skew import running_counts


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete correlations of any number of numeric columns, long form, from one pass.

    Each task multiplies its rows' column blocks: products of values, of values and squares with the marks of what is not null, and
    counts. Sums of these matrices over tasks give every pair's moments. Values are shifted by rough
    means beforehand, which changes digits only. Pairs with fewer than two common rows or without variance have a null.
    """
    cols = list(cols)
    k = len(cols)
    shift = df.select(*cols).limit(1000).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([float(v) if np.isfinite(v) else 0.0 for v in shift])

    def run(batches):
        total = np.zeros((5, k, k))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = np.column_stack([np.asarray(c.fill_null(float("nan"))) for c in part.columns]) - shift
                m = np.column_stack([np.asarray(c.is_valid()) for c in part.columns]).astype(float)
                x = np.where(m > 0, x, 0.0)
                total += [m.T @ m, x.T @ x, x.T @ m, (x * x).T @ m, m.T @ x]
        # By pair: rows, product, sum of the first, its squares, sum of the second; the second's squares are the transpose of the fourth.
        moments = np.stack([*total, total[3].T], axis=-1)
        at = [(i, j) for i in range(k) for j in range(i + 1, k)]
        yield pa.record_batch([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), *[pa.array([moments[i, j, c] for i, j in at], pa.float64()) for c in range(6)]],
                              ["i", "j", "n", "ab", "a", "aa", "b", "bb"])

    parts = df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(run, "i int, j int, n double, ab double, a double, aa double, b double, bb double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "ab", "a", "aa", "b", "bb")])
    spread = (F.col("aa") - F.col("a") * F.col("a") / F.col("n")) * (F.col("bb") - F.col("b") * F.col("b") / F.col("n"))
    r = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(spread)
    name = F.array(*[F.lit(c) for c in cols])
    return s.select(F.get(name, F.col("i")).alias("var_a"), F.get(name, F.col("j")).alias("var_b"), F.when((F.col("n") > 1) & (spread > 0), r).alias("r"))


def one_hot(df: DataFrame, column: str, levels) -> DataFrame:
    """Indicator columns for the listed levels."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in levels})


def _two_sample_counts(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull() & is_first.isNotNull())
        .groupBy(value)
        .agg(F.count_if(is_first).alias("n1"), F.count_if(~is_first).alias("n2"))
    )


def ks_two_sample(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """Kolmogorov-Smirnov statistic of two samples with the asymptotic p value."""
    r = running_counts(_two_sample_counts(df, value, is_first), [], value, ["n1", "n2"])
    gap = F.abs(F.col("n1_upto") / F.col("n1_all") - F.col("n2_upto") / F.col("n2_all"))
    one = r.agg(F.max(gap).alias("d"), F.max("n1_all").alias("n1"), F.max("n2_all").alias("n2"))
    return one.withColumn("p_value", kolmogorov_tail(F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))))


def kolmogorov_tail(lam: Column) -> Column:
    """Probability that the Kolmogorov distribution exceeds ``lam``.

    Two series for the same function: one converges fast above 1, its dual fast below. Eight terms of either leave
    less than 1e-15.
    """
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    above = total([(2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 9)])
    dual = total([F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8) / (lam * lam)) for k in range(1, 9)])
    below = 1.0 - math.sqrt(2 * math.pi) / lam * dual
    return F.when(lam <= 0, 1.0).when(lam < 1, below).otherwise(above)


def rank_sum_test(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """Wilcoxon rank-sum test by the normal approximation, with ties and continuity correction."""
    vc = _two_sample_counts(df, value, is_first).withColumn("t", F.col("n1") + F.col("n2"))
    r = running_counts(vc, [], value, ["t"])
    mid_rank = F.col("t_upto") - (F.col("t") - 1) / 2.0
    t = F.col("t").cast("double")
    one = r.agg(
        F.sum(F.col("n1") * mid_rank).alias("rank_sum"),
        F.sum("n1").cast("double").alias("n1"),
        F.sum("n2").cast("double").alias("n2"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    w = F.col("rank_sum") - n1 * (n1 + 1) / 2
    centre = w - n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (centre - F.signum(centre) * 0.5) / sigma
    return one.select(
        F.col("n1").cast("long").alias("n1"),
        F.col("n2").cast("long").alias("n2"),
        w.alias("w"),
        z.alias("z"),
        two_sided_normal(z).alias("p_value"),
    )


def fit_glm(df: DataFrame, response: str, features, family: str = "gaussian", **params):
    """Generalised linear model on complete rows; the solver sums over partitions."""
    data = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(
        df.where(F.col(response).isNotNull())
    )
    glm = GeneralizedLinearRegression(
        family=family, labelCol=response, featuresCol="features", predictionCol="fitted", **params
    )
    return glm.fit(data.select("features", response))


def fit_tweedie(df: DataFrame, response: str, features, variance_power: float = 1.5):
    """Tweedie model with log link, variance power set by the user."""
    return fit_glm(df, response, features, "tweedie", variancePower=variance_power, linkPower=0.0)


def coefficient_table(spark, models: dict) -> DataFrame:
    """Coefficients of several models, long form: model, term, estimate."""
    rows = []
    for name, (model, features) in models.items():
        rows.append((name, "(intercept)", float(model.intercept)))
        rows += [(name, f, float(v)) for f, v in zip(features, model.coefficients)]
    return spark.createDataFrame(rows, "model string, term string, estimate double")


def aic_table(spark, models: dict) -> DataFrame:
    """AIC per model for families that define it."""
    rows = [(n, float(m.summary.aic)) for n, (m, _) in models.items()]
    return spark.createDataFrame(rows, "model string, aic double")


def predict(df: DataFrame, model, features) -> DataFrame:
    v = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return model.transform(v.transform(df)).drop("features")


def _complete(df: DataFrame, response: str, features, year: str) -> tuple[DataFrame, list[str]]:
    """Complete rows as columns ``_y``, ``_x0`` (constant 1), ``_x1`` ... and the year."""
    x = [f"_x{i}" for i in range(len(features) + 1)]
    rows = df.select(F.col(year).alias("_year"), F.col(response).cast("double").alias("_y"), F.lit(1.0).alias("_x0"),
                     *[F.col(f).cast("double").alias(n) for f, n in zip(features, x[1:])]).dropna()
    return rows, x


def year_forward_scores(df: DataFrame, response: str, features, year: str, years) -> DataFrame:
    """Train on all years before a year, score that year; Gaussian log score and root mean squared error.

    One pass: sums of squares and products by year. Running totals over years are the normal equations of each year's training
    rows, and the errors of the held year follow from its own sums, so no row is read again. The driver holds one small matrix per year.
    """
    rows, x = _complete(df, response, features, year)
    names = [*x, "_y"]
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = {r["_year"]: r for r in rows.groupBy("_year").agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_{i}_{j}") for i, j in at]).collect()}

    def gram(y) -> np.ndarray:
        out = np.zeros((len(names), len(names)))
        for i, j in at:
            out[i, j] = out[j, i] = sums[y][f"_{i}_{j}"]
        return out

    out, seen, p = [], np.zeros((len(names), len(names))), len(x)
    for y in sorted(sums):
        held = gram(y)
        n, trained = held[0, 0], seen[0, 0]
        if y in years and trained > p:
            beta = np.linalg.lstsq(seen[:p, :p], seen[:p, p], rcond=None)[0]
            error = lambda g: float(g[p, p] - 2 * beta @ g[:p, p] + beta @ g[:p, :p] @ beta)  # noqa: E731, B023
            variance = error(seen) / (trained - p)
            score = -0.5 * n * math.log(2 * math.pi * variance) - error(held) / (2 * variance) if variance > 0 else None
            out.append((y, int(n), score if score is None else float(score), math.sqrt(max(error(held), 0.0) / n)))
        seen = seen + held
    kind = df.schema[year].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"`{year}` {kind}, n long, log_score double, rmse double")


def year_forward_tweedie(df: DataFrame, response: str, features, year: str, years, variance_power: float = 1.5, rounds: int = 50) -> DataFrame:
    """Train a Tweedie model with log link on all years before a year, score that year: mean unit deviance and root mean squared error.

    All years' models are fitted at once by weighted least squares: a round is one job, in which a row adds to the sums of every
    later year under that year's current coefficients. Rounds end when no coefficient moves by more than 1e-9 of its size.
    """
    rows, x = _complete(df, response, features, year)
    rows = staged(rows)
    p, k = variance_power, len(x)
    kind = df.schema[year].dataType.simpleString()
    each = rows.groupBy("_year").agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    beta = {}
    for y in years:
        s, n = (sum(r[c] for r in each if r["_year"] < y) for c in ("s", "n"))
        if n and s > 0:
            beta[y] = np.array([math.log(s / n)] + [0.0] * (k - 1))

    def with_models(which: Column) -> DataFrame:
        models = F.array(*[F.struct(F.lit(y).cast(kind).alias("y"), F.array(*[F.lit(float(c)) for c in b]).alias("b")) for y, b in beta.items()])
        m = rows.withColumn("_m", F.explode(F.filter(models, lambda m: which(m["y"]))))
        eta = reduce(lambda a, c: a + c, [F.col("_m.b")[i] * F.col(c) for i, c in enumerate(x)])
        return m.withColumn("_eta", eta).withColumn("_mu", F.exp("_eta"))

    at = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds if beta else 0):
        t = with_models(lambda y: F.col("_year") < y)
        w = F.pow("_mu", F.lit(2.0 - p))
        z = F.col("_eta") + (F.col("_y") - F.col("_mu")) / F.col("_mu")
        got = t.groupBy(F.col("_m.y").alias("y")).agg(
            *[F.sum(w * F.col(x[i]) * F.col(x[j])).alias(f"_{i}_{j}") for i, j in at], *[F.sum(w * z * F.col(c)).alias(f"_z{i}") for i, c in enumerate(x)]
        ).collect()
        moved = 0.0
        for r in got:
            gram = np.array([[r[f"_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            new = np.linalg.lstsq(gram, np.array([r[f"_z{i}"] for i in range(k)]), rcond=None)[0]
            moved = max(moved, float(np.max(np.abs(new - beta[r["y"]]) / np.maximum(1.0, np.abs(new)))))
            beta[r["y"]] = new
        if moved < 1e-9:
            break
    if not beta:
        return df.sparkSession.createDataFrame([], f"`{year}` {kind}, n long, deviance double, rmse double")
    t = with_models(lambda y: F.col("_year") == y)
    y, m = F.col("_y"), F.col("_mu")
    unit = 2 * (F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p)) - y * F.pow(m, F.lit(1 - p)) / (1 - p) + F.pow(m, F.lit(2 - p)) / (2 - p))
    return t.groupBy(F.col("_year").alias(year)).agg(F.count(F.lit(1)).alias("n"), F.avg(unit).alias("deviance"), F.sqrt(F.avg(F.pow(y - m, F.lit(2.0)))).alias("rmse"))


def back_transform(df: DataFrame, est: str, se: str, z: float = 1.96) -> DataFrame:
    """Response-scale estimate and interval of a log-link prediction."""
    return df.withColumns(
        {
            "fit": F.exp(est),
            "lo": F.exp(F.col(est) - z * F.col(se)),
            "hi": F.exp(F.col(est) + z * F.col(se)),
        }
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts and density in equal bins; values outside fall into bins 0 and ``bins + 1``."""
    width = (hi - lo) / bins
    g = df.where(F.col(value).isNotNull()).groupBy(
        F.width_bucket(F.col(value), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(value)).scalar()
    return g.select("bin", (F.lit(lo) + (F.col("bin") - 1) * width).alias("bin_start"), "n", (F.col("n") / (total * width)).alias("density"))

"""Statistics over the given tables."""

from pyspark.sql import functions as F

from ..operators import stats as st
from ..session import staged
from .bindings import CTES
from .core import query

_V = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix", "M1", doubles="r",
    sql=" UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r FROM (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem)"
        for i, a in enumerate(_V) for b in _V[i + 1:]
    ),
)
def correlation_matrix(t):
    li = t.read("lineitem").select("l_quantity", "l_extendedprice", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"))
    return st.correlation_matrix(li, _V)


@query(
    "one_hot_correlation", "M2 M1", doubles="r",
    sql=" UNION ALL ".join(
        f"SELECT 'l_quantity' AS var_a, 'l_returnflag_{v}' AS var_b, corr(l_quantity, CASE WHEN l_returnflag = '{v}' THEN 1e0 ELSE 0 END) AS r FROM lineitem" for v in "ANR"
    ),
)
def one_hot_correlation(t):
    h = st.one_hot(t.read("lineitem").select("l_quantity", "l_returnflag"), "l_returnflag", ["A", "N", "R"])
    return st.correlation_matrix(h, ["l_quantity", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R"]).where("var_a = 'l_quantity'")


# The plain alternating series, with as many terms as it takes.
_KS_P = "(SELECT sum(CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * lam)) FROM range(1, 20001) t(k))"


@query(
    "ks_two_sample", "M3", doubles="d p_value", digits=8,
    sql=f"""SELECT d, n1, n2, least(1e0, greatest(0e0, {_KS_P})) AS p_value FROM (SELECT *, d * d * n1 * n2 / (n1 + n2) AS lam FROM (SELECT max(abs(c1 / n1 - c2 / n2)) AS d, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM (
        SELECT sum(a) OVER (ORDER BY v) AS c1, sum(b) OVER (ORDER BY v) AS c2, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM (
        SELECT l_extendedprice AS v, count_if(l_returnflag = 'A') AS a, count_if(l_returnflag <> 'A') AS b FROM lineitem GROUP BY 1))))""",
)
def ks_two_sample(t):
    return st.ks_two_sample(t.read("lineitem"), "l_extendedprice", F.col("l_returnflag") == "A")


# Both tails of the normal density by Simpson sums.
_PHI = """(SELECT sum(CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp((abs(z) + i * 0.00125e0) ** 2 / -2)) * 0.00125e0 / 3 * 2 / sqrt(2 * pi()) FROM range(8001) t(i))"""


@query(
    "rank_sum_test", "M4", doubles="w z p_value",
    sql=f"""SELECT n1, n2, w, z, {_PHI} AS p_value FROM (SELECT * FROM (SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, w, (w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5e0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM (
        SELECT n1, n2, rs - n1 * (n1 + 1) / 2 AS w, ties FROM (SELECT sum(a * mid) AS rs, CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(b) AS DOUBLE) AS n2, sum(CAST(a + b AS DOUBLE) ** 3 - (a + b)) AS ties FROM (
        SELECT a, b, sum(a + b) OVER (ORDER BY v) - (a + b - 1) / 2 AS mid FROM (SELECT l_quantity AS v, count_if(l_linestatus = 'O') AS a, count_if(l_linestatus <> 'O') AS b FROM lineitem GROUP BY 1))))))""",
)
def rank_sum_test(t):
    return st.rank_sum_test(t.read("lineitem"), "l_quantity", F.col("l_linestatus") == "O")


def _orders_post(t):
    return t.read("orders").select("o_totalprice", (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("double").alias("is_post"))


@query(
    "gaussian_factor_model", "M5 M8 M10", doubles="estimate", digits=4,
    sql="""SELECT 'pre_post' AS model, '(intercept)' AS term, avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS estimate FROM orders UNION ALL
        SELECT 'pre_post', 'is_post', avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') - avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-01-01') FROM orders""",
)
def gaussian_factor_model(t):
    o = _orders_post(t)
    m = st.fit_glm(o, "o_totalprice", ["is_post"])
    return st.coefficient_table(t.spark, {"pre_post": (m, ["is_post"])})


def _cell_features(t):
    e = t.effort.groupBy("cell_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("pings").cast("double").alias("pings"), F.first("depth").alias("depth"))
    return e.withColumns({"depth_z": F.col("depth") / 100, "winter": F.col("month").isin(12, 1, 2, 3, 4).cast("double")})


CTES["cell_features"] = """SELECT cell_id, year(date) AS year, month(date) AS month, CAST(sum(pings) AS DOUBLE) AS y, max(depth) / 100 AS x, CASE WHEN month(date) IN (12, 1, 2, 3, 4) THEN 1e0 ELSE 0e0 END AS w
    FROM effort GROUP BY cell_id, year(date), month(date)"""
# Moments about the mean of a response and two features, and the least-squares fit that follows from them.
_MOMENTS = """count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(w) AS mw, var_pop(y) * count(*) AS syy, var_pop(x) * count(*) AS sxx, var_pop(w) * count(*) AS sww,
    covar_pop(x, w) * count(*) AS sxw, covar_pop(x, y) * count(*) AS sxy, covar_pop(w, y) * count(*) AS swy"""
_SLOPES = "(sww * sxy - sxw * swy) / (sxx * sww - sxw * sxw) AS bx, (sxx * swy - sxw * sxy) / (sxx * sww - sxw * sxw) AS bw"


@query(
    "model_comparison", "M5 M8", doubles="aic", digits=3,
    sql=f"""WITH f AS (SELECT *, {_SLOPES} FROM (SELECT {_MOMENTS} FROM cell_features))
        SELECT 'depth' AS model, n * (ln(2 * pi() * (syy - sxy * sxy / sxx) / n) + 1) + 2 + 2 * 2 AS aic FROM f
        UNION ALL SELECT 'depth_winter', n * (ln(2 * pi() * (syy - bx * sxy - bw * swy) / n) + 1) + 2 + 2 * 3 FROM f""",
)
def model_comparison(t):
    d = staged(_cell_features(t))
    models = {
        "depth": (st.fit_glm(d, "pings", ["depth_z"]), ["depth_z"]),
        "depth_winter": (st.fit_glm(d, "pings", ["depth_z", "winter"]), ["depth_z", "winter"]),
    }
    return st.aic_table(t.spark, models)


# Weighted least squares about the weighted means, from the mean's logarithm on.
_ROUND = """SELECT k + 1 AS k, mz - bx * mx - bw * mw AS b0, bx, bw FROM (SELECT *, (sww * sxz - sxw * swz) / (sxx * sww - sxw * sxw) AS bx, (sxx * swz - sxw * sxz) / (sxx * sww - sxw * sxw) AS bw FROM (
    SELECT k, sz / s AS mz, sx / s AS mx, sw / s AS mw, xx - sx * sx / s AS sxx, ww - sw * sw / s AS sww, xw - sx * sw / s AS sxw, xz - sx * sz / s AS sxz, wz - sw * sz / s AS swz FROM (
    SELECT k, sum(u) AS s, sum(u * z) AS sz, sum(u * x) AS sx, sum(u * w) AS sw, sum(u * x * x) AS xx, sum(u * w * w) AS ww, sum(u * x * w) AS xw, sum(u * x * z) AS xz, sum(u * w * z) AS wz FROM (
    SELECT k, x, w, sqrt(exp(eta)) AS u, eta + y / exp(eta) - 1 AS z FROM (SELECT k, x, w, y, b0 + bx * x + bw * w AS eta FROM fit, cell_features WHERE k < 25)) GROUP BY k)))"""


@query(
    "tweedie_model", "M6 M9 M10", doubles="estimate", digits=4,
    sql=f"""WITH RECURSIVE fit AS (SELECT 0 AS k, ln(avg(y)) AS b0, 0e0 AS bx, 0e0 AS bw FROM cell_features UNION ALL {_ROUND})
        SELECT 'tweedie' AS model, unnest(['(intercept)', 'depth_z', 'winter']) AS term, unnest([b0, bx, bw]) AS estimate FROM fit WHERE k = 25""",
)
def tweedie_model(t):
    d = staged(_cell_features(t))
    m = st.fit_tweedie(d, "pings", ["depth_z", "winter"])
    coef = st.coefficient_table(t.spark, {"tweedie": (m, ["depth_z", "winter"])})
    return coef


def _years(d):
    """All years that have earlier ones to learn from."""
    return sorted(r[0] for r in d.select("year").distinct().collect())[1:]


@query(
    "year_forward_validation", "M7 M8", doubles="log_score rmse", digits=4,
    sql=f"""WITH s AS (SELECT h.year, {_MOMENTS} FROM cell_features d JOIN (SELECT DISTINCT year FROM cell_features) h ON d.year < h.year GROUP BY h.year),
        f AS (SELECT *, {_SLOPES} FROM s), g AS (SELECT *, my - bx * mx - bw * mw AS b0, (syy - bx * sxy - bw * swy) / (n - 3) AS v FROM f)
        SELECT d.year, count(*) AS n, sum(-0.5 * ln(2 * pi()) - 0.5 * ln(v) - (y - b0 - bx * x - bw * w) ** 2 / (2 * v)) AS log_score, sqrt(avg((y - b0 - bx * x - bw * w) ** 2)) AS rmse
        FROM cell_features d JOIN g ON g.year = d.year GROUP BY d.year""",
)
def year_forward_validation(t):
    d = _cell_features(t)
    return st.year_forward_scores(d, "pings", ["depth_z", "winter"], "year", _years(d))


@query(
    "gaussian_factor_aic", "M8", doubles="aic", digits=3,
    sql="""SELECT 'pre_post' AS model, n * (ln(2 * pi() * dev / n) + 1) + 2 + 2 * 2 AS aic FROM (SELECT count(*) AS n, sum((o_totalprice - m) ** 2) AS dev FROM orders
        JOIN (SELECT o_orderdate >= TIMESTAMP '1998-01-01' AS post, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON post = (o_orderdate >= TIMESTAMP '1998-01-01'))""",
)
def gaussian_factor_aic(t):
    o = _orders_post(t)
    return st.aic_table(t.spark, {"pre_post": (st.fit_glm(o, "o_totalprice", ["is_post"]), ["is_post"])})


@query(
    "tweedie_factor_model", "M6 M10", doubles="estimate", digits=4,
    sql="""WITH m AS (SELECT ln(avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-01-01')) AS a, ln(avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-01-01')) AS b FROM orders)
        SELECT 'tweedie' AS model, '(intercept)' AS term, a AS estimate FROM m UNION ALL SELECT 'tweedie', 'is_post', b - a FROM m""",
)
def tweedie_factor_model(t):
    m = st.fit_tweedie(_orders_post(t), "o_totalprice", ["is_post"])
    return st.coefficient_table(t.spark, {"tweedie": (m, ["is_post"])})


@query(
    "year_forward_tweedie", "M7 M6", doubles="deviance rmse", digits=3,
    sql="""WITH d AS (SELECT cell_id, year(date) AS year, month(date) IN (12, 1, 2, 3, 4) AS winter, CAST(sum(pings) AS DOUBLE) AS y FROM effort GROUP BY cell_id, year(date), month(date)),
        f AS (SELECT b.year, b.y, (SELECT avg(a.y) FROM d a WHERE a.year < b.year AND a.winter = b.winter) AS m FROM d b WHERE b.year > (SELECT min(year) FROM d))
        SELECT year, count(*) AS n, avg(2 * (sqrt(y) / -0.25e0 + 2 * y / sqrt(m) + 2 * sqrt(m))) AS deviance, sqrt(avg((y - m) ** 2)) AS rmse FROM f GROUP BY 1""",
)
def year_forward_tweedie(t):
    d = staged(_cell_features(t))
    return st.year_forward_tweedie(d, "pings", ["winter"], "year", _years(d))


@query(
    "back_transformed_predictions", "M9 P25", doubles="fit lo hi",
    sql="""SELECT cell_id, exp(est) AS fit, exp(est - 1.96 * se) AS lo, exp(est + 1.96 * se) AS hi FROM (SELECT cell_id, avg(ln(lbs)) AS est, stddev_samp(ln(lbs)) / sqrt(count(*)) AS se FROM effort GROUP BY 1)""",
)
def back_transformed_predictions(t):
    g = t.effort.groupBy("cell_id").agg(F.avg(F.log("lbs")).alias("est"), (F.stddev_samp(F.log("lbs")) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return st.back_transform(g, "est", "se").select("cell_id", "fit", "lo", "hi")


@query(
    "histogram_bins", "M11", doubles="bin_start density", digits=9,
    sql="""SELECT bin, (bin - 1) * 2500e0 AS bin_start, n, n / (sum(n) OVER () * 2500e0) AS density FROM (
        SELECT CAST(CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 41 ELSE floor(l_extendedprice / 2500) + 1 END AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def histogram_bins(t):
    return st.histogram(t.read("lineitem"), "l_extendedprice", 0.0, 100000.0, 40)

"""Projection, predicates and scalar expressions over the given tables."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import nulls as nl
from ..functions import scalars as sc
from ..operators.joins import apply_fixes
from ..plans import effort as eff
from .bindings import anchor_sql, crab_year_sql, half_month_sql, rollover_sql
from .core import query

OD = "CAST(o_orderdate AS DATE)"


def _orders(t, *cols):
    return t.read("orders").withColumn("d", F.col("o_orderdate").cast("date")).select("o_orderkey", "d", *cols)


@query(
    "fleet_trip_filter", "P1", doubles="lbs rev", digits=4,
    sql="""SELECT vessel_id, count(*) AS n, sum(l_quantity) AS lbs, sum(l_extendedprice) AS rev FROM (
        SELECT l.*, o_custkey AS vessel_id FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
        WHERE l_linestatus = 'O' AND (l_returnflag = 'A' OR o_orderstatus = 'A') AND l_linenumber IN (1, 2, 3)
        AND l_discount BETWEEN 0.01 AND 0.09 AND o_orderdate BETWEEN DATE '1996-11-01' AND DATE '2000-08-01'
        AND month(o_orderdate) IN (11, 12, 1, 2, 3, 4, 5, 6)) GROUP BY 1""",
)
def fleet_trip_filter(t):
    j = t.read("lineitem").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = eff.select_trips(
        j, agency=("l_linestatus", "O"), target=(("l_returnflag", "o_orderstatus"), "A"),
        removal_types=("l_linenumber", [1, 2, 3]), speed=("l_discount", 0.01, 0.09),
        dates=("o_orderdate", F.lit("1996-11-01").cast("timestamp_ntz"), F.lit("2000-08-01").cast("timestamp_ntz")),
        months=("o_orderdate", [11, 12, 1, 2, 3, 4, 5, 6]),
    )
    return s.groupBy(F.col("o_custkey").alias("vessel_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("lbs"), F.sum("l_extendedprice").alias("rev")
    )


@query(
    "ticket_cleaning", "P2",
    sql="""SELECT ticket_id, vessel_id, port, revenue FROM tickets WHERE removal IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
        AND port NOT IN (3, 7, 11) AND removal <> '2-HIGH' AND revenue > 0""",
)
def ticket_cleaning(t):
    c = eff.clean_tickets(
        t.tickets, keep={"removal": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, drop={"port": [3, 7, 11], "removal": ["2-HIGH"]}, positive=["revenue"]
    )
    return c.select("ticket_id", "vessel_id", "port", "revenue")


@query(
    "select_by_prefix", "P3",
    sql="SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey FROM supplier",
)
def select_by_prefix(t):
    s = t.read("supplier")
    return s.select(s.colRegex("`s_.*`")).drop("s_acctbal").withColumnsRenamed(
        {c: c[2:] for c in s.columns}
    )


@query(
    "time_keys", "P4",
    sql=f"""SELECT o_orderkey, year({OD}) AS year, strftime({OD}, '%Y_%m') AS year_month, monthname({OD}) AS month,
        month({OD}) AS month_as_numeric, (dayofyear({OD}) - 1) // 7 + 1 AS week_of_year, dayofyear({OD}) AS day_of_year FROM orders""",
)
def time_keys(t):
    return cal.time_keys(_orders(t), "d").drop("d")


@query(
    "season_keys", "P5",
    sql=f"""SELECT o_orderkey, {rollover_sql(OD, 11, '_')} AS crab_year, {rollover_sql(OD, 12, '-')} AS season,
        {rollover_sql(OD, 10, '-')} AS licence_season FROM orders""",
)
def season_keys(t):
    return _orders(t).select(
        "o_orderkey", cal.crab_year("d").alias("crab_year"), cal.season("d").alias("season"),
        cal.licence_season("d").alias("licence_season"),
    )


@query(
    "half_month_totals", "P6", doubles="revenue", digits=2,
    sql=f"""SELECT {rollover_sql(OD, 12, '-')} AS season, {half_month_sql(OD)} AS half_month, count(*) AS n, sum(o_totalprice) AS revenue
        FROM orders GROUP BY 1, 2""",
)
def half_month_totals(t):
    return _orders(t, "o_totalprice").groupBy(cal.season("d").alias("season"), cal.half_month("d").alias("half_month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("revenue")
    )


@query(
    "period_buckets", "P7",
    sql=f"""SELECT period, depth_class, count(*) AS n FROM (SELECT CASE WHEN y < 1997 THEN 'pre' WHEN y < 2000 THEN 'mhw' ELSE 'post' END AS period,
        CASE WHEN l_quantity <= 10 THEN '0-10' WHEN l_quantity <= 30 THEN '10-30' ELSE 'deep' END AS depth_class
        FROM (SELECT year(l_shipdate) AS y, l_quantity FROM lineitem)) GROUP BY 1, 2""",
)
def period_buckets(t):
    y = F.year("l_shipdate")
    return t.read("lineitem").groupBy(
        cal.bucket(y, [(y < 1997, "pre"), (y < 2000, "mhw")], "post").alias("period"),
        cal.bucket("l_quantity", [(F.col("l_quantity") <= 10, "0-10"), (F.col("l_quantity") <= 30, "10-30")], "deep").alias("depth_class"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "analysis_periods", "P7",
    sql=f"""SELECT cy AS crab_year, CASE WHEN e < 2015 THEN '2009-2014' WHEN e < 2019 THEN '2014-2018' ELSE '2018-2019' END AS period, count(*) AS n
        FROM (SELECT cy, CAST(substr(cy, 6, 4) AS INT) AS e FROM (SELECT {crab_year_sql('d')} AS cy FROM (SELECT CAST(o_orderdate AS DATE) + 5844 AS d FROM orders))) GROUP BY 1, 2""",
)
def analysis_periods(t):
    o = _orders(t).withColumn("crab_year", cal.crab_year(F.date_add("d", 5844)))
    return o.groupBy("crab_year", cal.period_of("crab_year").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "season_flags", "P8",
    sql=f"""SELECT o_orderkey, CASE WHEN month({OD}) IN (12, 1, 2, 3, 4) THEN 'Winter' WHEN month({OD}) BETWEEN 5 AND 9 THEN 'Summer' END AS season_flag,
        month({OD}) BETWEEN 5 AND 9 AS may_sep FROM orders""",
)
def season_flags(t):
    return _orders(t).select("o_orderkey", cal.winter_summer("d").alias("season_flag"), cal.is_may_sep("d").alias("may_sep"))


_B = [0, 10, 25, 40, 50]


@query(
    "interval_bins", "P9",
    sql="""SELECT left_open, right_open, label, count(*) AS n FROM (SELECT
        (l_quantity > 0)::INT + (l_quantity > 10)::INT + (l_quantity > 25)::INT + (l_quantity > 40)::INT + (l_quantity > 50)::INT AS left_open,
        (l_quantity >= 0)::INT + (l_quantity >= 10)::INT + (l_quantity >= 25)::INT + (l_quantity >= 40)::INT + (l_quantity >= 50)::INT AS right_open,
        CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'a' WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'b'
             WHEN l_quantity > 25 AND l_quantity <= 40 THEN 'c' WHEN l_quantity > 40 AND l_quantity <= 50 THEN 'd' END AS label
        FROM lineitem) GROUP BY 1, 2, 3""",
)
def interval_bins(t):
    return t.read("lineitem").groupBy(
        sc.find_interval("l_quantity", _B, left_open=True).alias("left_open"),
        sc.find_interval("l_quantity", _B).alias("right_open"),
        sc.cut_labels("l_quantity", _B, ["a", "b", "c", "d"]).alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "latitude_bands", "P10",
    sql=f"""SELECT region, CASE WHEN region IN ('CenCA', 'NorCA') THEN 'CA' ELSE region END AS state, count(*) AS n, sum(lbs) AS lbs FROM pings JOIN grid USING (cell_id) GROUP BY 1, 2""",
)
def latitude_bands(t):
    j = t.pings.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.sum("lbs").alias("lbs")).join(t.grid, "cell_id")
    return j.groupBy(sc.region_of("lat").alias("region"), sc.state_of("lat").alias("state")).agg(
        F.sum("n").alias("n"), F.sum("lbs").alias("lbs")
    )


@query(
    "region_collapse", "P11",
    sql="""SELECT area, strict_area, count(*) AS n FROM (SELECT CASE region WHEN 'CenCA' THEN 'CA' WHEN 'NorCA' THEN 'CA' ELSE region END AS area,
        CASE region WHEN 'CenCA' THEN 'CA' WHEN 'NorCA' THEN 'CA' END AS strict_area FROM cases) GROUP BY 1, 2""",
)
def region_collapse(t):
    m = {"CenCA": "CA", "NorCA": "CA"}
    return t.events.groupBy(sc.recode("region", m).alias("area"), sc.recode("region", m, keep_other=False).alias("strict_area")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "class_thresholds", "P12",
    sql="""SELECT cell_id, n_vessels, CASE WHEN n_vessels < 3 THEN 'confidential' ELSE 'open' END AS privacy,
        CASE WHEN mean_size >= 2450 THEN '>=40 ft' ELSE '<40 ft' END AS size_class FROM (
        SELECT cell_id, count(DISTINCT vessel_id) AS n_vessels, avg(lbs * 100) AS mean_size FROM pings GROUP BY 1)""",
)
def class_thresholds(t):
    g = t.pings.groupBy("cell_id").agg(F.countDistinct("vessel_id").alias("n_vessels"), F.avg(F.col("lbs") * 100).alias("s"))
    return g.select(
        "cell_id", "n_vessels", F.when(F.col("n_vessels") < 3, "confidential").otherwise("open").alias("privacy"),
        F.when(F.col("s") >= 2450, ">=40 ft").otherwise("<40 ft").alias("size_class"),
    )


@query(
    "null_and_value", "P13",
    sql="""SELECT l_linenumber, count(nullif(l_discount, 0)) AS n_nonzero, sum(coalesce(nullif(l_discount, 0), -1)) AS filled,
        sum(CASE WHEN l_tax = 0 THEN NULL WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS safe_flag FROM lineitem GROUP BY 1""",
    doubles="filled",
)
def null_and_value(t):
    d = F.nullif(F.col("l_discount"), F.lit(0.0))
    tax = F.nullif(F.col("l_tax"), F.lit(0.0))
    return t.read("lineitem").groupBy("l_linenumber").agg(
        F.count(d).alias("n_nonzero"), F.sum(F.coalesce(d, F.lit(-1.0))).alias("filled"),
        F.sum(nl.if_na_safe(tax > 0.04, F.lit(1), F.lit(0))).alias("safe_flag"),
    )


@query(
    "lossy_number_cast", "P14",
    sql="""SELECT c_custkey, TRY_CAST(split_part(c_name, '#', 2) AS DOUBLE) AS number_part, TRY_CAST(c_name AS DOUBLE) AS whole_name FROM customer""",
)
def lossy_number_cast(t):
    return t.read("customer").select(
        "c_custkey", nl.number_or_null(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("number_part"), nl.number_or_null("c_name").alias("whole_name")
    )


@query(
    "year_repair", "P15",
    sql=f"""SELECT o_orderkey, CAST(CASE WHEN year({OD}) <> s AND year({OD}) <> s + 1 THEN {OD} - INTERVAL 1 YEAR ELSE {OD} END AS DATE) AS repaired
        FROM (SELECT *, CAST(1995 + o_orderkey % 6 AS INT) AS s FROM orders)""",
)
def year_repair(t):
    o = _orders(t).withColumn("s", (1995 + F.col("o_orderkey") % 6).cast("int"))
    return o.select("o_orderkey", cal.repair_year("d", "s").alias("repaired"))


@query(
    "season_start_text", "P16",
    sql=f"""SELECT o_orderkey, TRY_CAST(printf('%d-%02d-%02d', CASE WHEN month({OD}) >= 10 THEN y ELSE y + 1 END, month({OD}), day({OD})) AS DATE) AS start_date
        FROM (SELECT *, 1995 + o_orderkey % 6 AS y FROM orders)""",
)
def season_start_text(t):
    # Feb. 29 has no date in most of these seasons and becomes null.
    o = _orders(t).withColumn("y", (1995 + F.col("o_orderkey") % 6).cast("int")).withColumn("txt", F.concat(F.date_format("d", "MMM"), F.lit(". "), F.dayofmonth("d").cast("string")))
    return o.select("o_orderkey", cal.parse_season_start("txt", "y").alias("start_date"))


@query(
    "degrees_minutes", "P17", doubles="lat lon",
    sql="""SELECT event_id, coalesce(nullif(value, 6.55), user_id + (event_id % 60) / 60e0) AS lat, -(user_id + (event_id % 60) / 60e0) AS lon FROM events""",
)
def degrees_minutes(t):
    m = F.col("event_id") % 60
    return t.read("events").select(
        "event_id", sc.dms_to_decimal("user_id", m, F.nullif(F.col("value"), F.lit(6.55))).alias("lat"),
        sc.dms_to_decimal("user_id", m, negative=True).alias("lon"),
    )


@query(
    "composite_keys", "P18",
    sql=f"""SELECT o_orderkey, k AS set_key, substr(k, 1, 9) AS season, split_part(k, '_', 2) AS ticket_no FROM (
        SELECT o_orderkey, {rollover_sql(OD, 12, '-')} || '_' || o_orderkey AS k FROM orders)""",
)
def composite_keys(t):
    o = _orders(t).withColumn("set_key", sc.concat_key(cal.season("d"), "o_orderkey"))
    return o.select(
        "o_orderkey", "set_key", F.substring("set_key", 1, 9).alias("season"), F.split_part("set_key", F.lit("_"), F.lit(2)).alias("ticket_no")
    )


@query(
    "uneven_split", "P19",
    sql="""SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, nullif(split_part(p_name, ' ', 2), '') AS second_word,
        nullif(split_part(p_name, ' ', 3), '') AS third_word FROM part""",
)
def uneven_split(t):
    return sc.split_into(t.read("part"), "p_name", ["first_word", "second_word", "third_word"], " ").select(
        "p_partkey", "first_word", "second_word", "third_word"
    )


@query(
    "text_cleaning", "P20",
    sql="""SELECT p_partkey, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS tidy,
        replace(p_brand, 'Brand#', 'B-') AS brand, length(p_type) AS type_length, regexp_matches(p_name, 'red|blue') AS has_color FROM part""",
)
def text_cleaning(t):
    messy = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit(" "))
    return t.read("part").select(
        "p_partkey", sc.clean_text(messy).alias("tidy"), F.replace("p_brand", F.lit("Brand#"), F.lit("B-")).alias("brand"),
        F.length("p_type").alias("type_length"), F.col("p_name").rlike("red|blue").alias("has_color"),
    )


@query(
    "month_lookup", "P21 O4",
    sql=f"""SELECT monthname({OD}) AS month, month({OD}) AS month_no, CASE WHEN month({OD}) = 12 THEN 1 WHEN month({OD}) <= 9 THEN month({OD}) + 1 END AS season_index,
        count(*) AS n FROM orders GROUP BY 1, 2, 3""",
)
def month_lookup(t):
    o = _orders(t).withColumn("month", cal.month_name("d"))
    return o.groupBy("month").agg(F.count(F.lit(1)).alias("n")).select(
        "month", cal.month_number("month").alias("month_no"), cal.season_month_index("month").alias("season_index"), "n"
    ).orderBy(F.asc_nulls_last("season_index"), "month_no")


@query(
    "day_of_year_dates", "P22",
    sql=f"SELECT o_orderkey, {OD} AS rebuilt FROM orders",
)
def day_of_year_dates(t):
    o = _orders(t).select("o_orderkey", F.year("d").alias("y"), F.dayofyear("d").alias("doy"))
    return o.select("o_orderkey", cal.doy_to_date("y", "doy").alias("rebuilt"))


@query(
    "anchored_dates", "P23",
    sql=f"""SELECT crab_year, {anchor_sql(12, 15)} AS opening, {anchor_sql(4, 1)} AS closure, count(*) AS n
        FROM (SELECT {crab_year_sql(OD)} AS crab_year FROM orders) GROUP BY 1, 2, 3""",
)
def anchored_dates(t):
    g = _orders(t).groupBy(cal.crab_year("d").alias("crab_year")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(
        "crab_year", cal.anchor_date(F.lit(12), F.lit(15), "crab_year").alias("opening"),
        cal.anchor_date(F.lit(4), F.lit(1), "crab_year").alias("closure"), "n",
    )


@query(
    "date_windows", "P24",
    sql="""SELECT l_linestatus, count(*) AS n, sum(date_diff('day', d, s)) AS total_days, sum((s BETWEEN d AND d + 365)::INT) AS n_within,
        count(DISTINCT CAST(d - INTERVAL 3 MONTH AS DATE)) AS n_shifted FROM (
        SELECT l_linestatus, CAST(o_orderdate AS DATE) AS d, CAST(l_shipdate AS DATE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
)
def date_windows(t):
    j = t.read("lineitem").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_linestatus", F.col("o_orderdate").cast("date").alias("d"), F.col("l_shipdate").cast("date").alias("s")
    )
    return j.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cal.days_between("s", "d")).alias("total_days"),
        F.count_if(cal.within("s", "d", F.date_add("d", 365))).alias("n_within"),
        F.countDistinct(F.add_months("d", -3)).alias("n_shifted"),
    )


@query(
    "scale_transforms", "P25", doubles="log_rev root4 back root",
    sql="""SELECT o_orderkey, ln(o_totalprice) AS log_rev, pow(o_totalprice, 0.25) AS root4, exp(ln(o_totalprice) / 3) AS back, sqrt(o_totalprice) AS root FROM orders""",
)
def scale_transforms(t):
    c = F.col("o_totalprice")
    return t.read("orders").select(
        "o_orderkey", F.log(c).alias("log_rev"), sc.fourth_root(c).alias("root4"), F.exp(F.log(c) / 3).alias("back"), F.sqrt(c).alias("root")
    )


@query(
    "clamp_to_later_date", "P26",
    sql="""SELECT l_orderkey, l_linenumber, max(CASE WHEN s IS NULL THEN NULL ELSE greatest(d, s) END) AS clamped FROM (
        SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS d, CASE WHEN l_tax > 0 THEN CAST(l_shipdate AS DATE) END AS s
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2""",
)
def clamp_to_later_date(t):
    j = t.read("lineitem").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("o_orderdate").cast("date").alias("d"),
        F.when(F.col("l_tax") > 0, F.col("l_shipdate").cast("date")).alias("s"),
    )
    return j.groupBy("l_orderkey", "l_linenumber").agg(F.max(nl.later_of("d", "s")).alias("clamped"))


@query(
    "manual_corrections", "P27",
    sql="""SELECT ticket_id, coalesce(fix, port) AS port FROM tickets LEFT JOIN (SELECT c_custkey, (c_nationkey + 1) % 25 AS fix FROM customer
        WHERE c_acctbal < 0) ON vessel_id = c_custkey""",
)
def manual_corrections(t):
    fixes = t.read("customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("vessel_id"), ((F.col("c_nationkey") + 1) % 25).alias("port")
    )
    return apply_fixes(t.tickets, fixes, "vessel_id", "port").select("ticket_id", "port")


@query(
    "column_wise_scaling", "P28", doubles="o_totalprice o_shippriority",
    sql="SELECT o_orderkey, o_totalprice / 1000 AS o_totalprice, o_custkey / 1000 AS o_shippriority FROM orders",
)
def column_wise_scaling(t):
    o = t.read("orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("o_shippriority"))
    return sc.map_columns(o, ["o_totalprice", "o_shippriority"], lambda c: c / 1000)


@query(
    "row_wise_sums", "P29", doubles="total",
    sql="""SELECT l_orderkey, sum(coalesce(nullif(l_tax, 0), 0) + coalesce(nullif(l_discount, 0.05), 0) + l_quantity) AS total FROM lineitem GROUP BY 1""",
)
def row_wise_sums(t):
    s = nl.row_sum(F.nullif(F.col("l_tax"), F.lit(0.0)), F.nullif(F.col("l_discount"), F.lit(0.05)), "l_quantity")
    return t.read("lineitem").groupBy("l_orderkey").agg(F.sum(s).alias("total"))


@query(
    "row_null_tests", "P30",
    sql="""SELECT l_linenumber, count_if(a IS NOT NULL OR b IS NOT NULL) AS n_any, count_if(a IS NOT NULL AND b IS NOT NULL) AS n_all FROM (
        SELECT l_linenumber, nullif(l_tax, 0) AS a, nullif(l_discount, 0) AS b FROM lineitem) GROUP BY 1""",
)
def row_null_tests(t):
    a, b = F.nullif(F.col("l_tax"), F.lit(0.0)), F.nullif(F.col("l_discount"), F.lit(0.0))
    return t.read("lineitem").groupBy("l_linenumber").agg(
        F.count_if(nl.any_not_null(a, b)).alias("n_any"), F.count_if(nl.all_not_null(a, b)).alias("n_all")
    )

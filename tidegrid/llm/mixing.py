"""Mixing sources to target weights by Pareto order sampling.

Targets in words come from the weights, capped and reshared. Every document first gets its
certain whole copies; what is left of an expected number of copies is its inclusion
probability p. Documents are ranked by the odds of a fixed random number over the odds of
p. The first of each source that fit into what its target lacks get one more copy, then those further
down that still fit, round by round, until nothing fits any more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, rows_of, stage, table, text_digest, word_count

WEIGHTS, CAP = (1, 2, 3), 3
#: Ranks are summed by this many slices first, so that only one slice of a source is put in order.
SLICES = 4096
#: Sources up to which what is known of each is broadcast; with more of them it is joined by shuffles.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(k, source_size, target) per source. Works on one row per source.

    Sources in code-point order, null last, have ``weights`` in turn and share the sum of
    all sizes. No target exceeds ``cap`` times its source's size; the excess goes to the
    others by weight. In the order of cap over weight the first ones are capped; the level of the rest is the
    largest that any number of capped sources gives.
    """
    per = sizes.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    s = per.withColumn("w", F.get(turn, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).cast("long"))
    s = s.withColumn("most", F.col("source_size") * cap)
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(every) - spent("most")) / (F.sum("w").over(every) - spent("w")))
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("k", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        preference: str | None = None, weights=WEIGHTS, cap: int = CAP, seed: str = "", mark: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken, and ``mark``, if a column is named that tells rows with one id apart.

    ``size`` is the number of words, ``copies`` how often the mix has the document (0 to
    ``cap``), ``taken`` their product. Expected copies are the source's target over its size, times the row's share by
    the column ``preference`` where one is named (positive; null or others count as 1). Null and empty
    texts have size 0 and take nothing. Null is a source like others. Equal ranks are ordered by id and
    size; rows that repeat all of these are drawn one by one. Random numbers are hashes of id and ``seed``, so reruns agree.
    An empty table gives no rows.
    """
    uniform = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(seed))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    liked = F.lit(1.0) if preference is None else F.when(F.col(preference) > 0, F.col(preference).cast("double")).otherwise(1.0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
                       uniform.alias("u"), liked.alias("liked"), F.monotonically_increasing_id().alias("row"), *([] if mark is None else [F.col(mark).alias("mark")]))
    rows = stage(rows.withColumn("k", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix-sizes")
    plan = stage(source_targets(rows, weights, cap), "mix-targets")
    each = F.broadcast if plan.count() <= BROADCAST_SOURCES else lambda df: df  # tables with one row per source
    scale = rows.groupBy("k").agg(F.try_divide(F.sum("size"), F.sum(F.col("size") * F.col("liked"))).alias("scale"))
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size") * F.col("liked") * F.coalesce("scale", F.lit(1.0)))).otherwise(0.0)
    ranked = rows.join(each(plan.join(scale, "k")), "k").withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
    p = F.greatest(F.lit(1e-9), F.col("expected") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    free = (F.col("size") > 0) & (F.col("whole") < cap)
    ranked = ranked.withColumn("rank", F.when(free, odds / (1 + odds))).withColumn("slice", F.floor(F.col("rank") * SLICES))
    marks = [] if mark is None else ["mark"]
    ranked = stage(ranked.select("row", "id", "k", "size", "source_size", "target", "whole", "rank", "slice", *marks), "mix-ranks")
    mixed = _filled(ranked, each, cap)
    copies = F.col("whole") + F.col("extra")
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *marks)


def _filled(ranked: DataFrame, each, cap: int) -> DataFrame:
    """``ranked`` with ``extra`` copies, so that each source's words come as near its target as what fits allows.

    A round goes down the ranks, documents with fewer extra copies first, as long as sizes fit into the source's gap. The gap only shrinks, so
    a document that is larger than it or has ``cap`` copies is settled and read no more. Rounds end when no open document
    fits; one document that overshoots by less than the gap may then close it.
    """
    gaps = stage(ranked.groupBy("k").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("gap")), "mix-gaps")
    active, settled = ranked.withColumn("extra", F.lit(0)), []
    part = F.col("extra") * SLICES + F.col("slice")
    fits = F.col("rank").isNotNull() & (F.col("whole") + F.col("extra") < cap) & (F.col("size") <= F.col("gap"))
    while True:
        held = active.join(each(gaps), "k").withColumn("part", F.when(fits, part))
        settled.append(held.where("part IS NULL").drop("part", "gap"))
        # Sums by slices of rank say where the gap is used up; only that slice of a source is put in order.
        sums = held.where("part IS NOT NULL").groupBy("k", "part", "gap").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto).where("upto > gap").groupBy("k").agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("before"))).alias("m"))
        last = stage(sums.select("k", F.col("m.part").alias("last"), F.col("m.before").alias("before")), "mix-last-slice")
        placed = held.where("part IS NOT NULL").join(each(last), "k", "left")
        running = F.col("before") + F.sum("size").over(Window.partitionBy("k").orderBy("rank", "id", "size", "row"))
        edge = placed.where("part = last").withColumn("add", (running <= F.col("gap")).cast("int"))
        rest = placed.where("last IS NULL OR part <> last").withColumn("add", (F.col("last").isNull() | (F.col("part") < F.col("last"))).cast("int"))
        drawn = stage(rest.unionByName(edge).withColumn("extra", F.col("extra") + F.col("add")).drop("part", "gap", "last", "before"), "mix-drawn")
        if drawn.isEmpty():
            break
        used = drawn.groupBy("k").agg(F.sum(F.col("size") * F.col("add")).alias("used"))
        gaps = stage(gaps.join(used, "k", "left").select("k", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")), "mix-gaps")
        active = drawn.drop("add")
    mixed = reduce(DataFrame.unionByName, settled)
    off = F.abs(F.col("gap") - F.col("size"))
    near = mixed.where(F.col("rank").isNotNull() & (F.col("whole") + F.col("extra") < cap)).join(each(gaps), "k").where(off < F.col("gap"))
    best = stage(near.groupBy("k").agg(F.min(F.struct(off, "extra", "rank", "id", "size", "row")).alias("b")).select("k", F.col("b.row").alias("best")), "mix-best")
    one_more = F.coalesce((F.col("row") == F.col("best")).cast("int"), F.lit(0))
    return mixed.join(each(best), "k", "left").withColumn("extra", F.col("extra") + one_more).drop("best")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix has it.

    Rows are told apart by id and text: rows that repeat both are one document here, which is drawn once; unlike texts
    with one id, or without an id, are drawn each.
    """
    own, digest, drawn_digest, copies, copy = fresh(docs, "drawn_id", "digest", "drawn_digest", "copies", "copy")
    known = docs.withColumn(digest, text_digest(text_col))
    drawn = mix(known, id_col, text_col, mark=digest, **how).where("copies > 0")
    drawn = drawn.groupBy(F.col(id_col).alias(own), F.col("mark").alias(drawn_digest)).agg(F.max("copies").cast("int").alias(copies))
    many = rows_of(known, drawn, {digest: drawn_digest, id_col: own})
    return many.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS k, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
  (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / {1 << 52}.0::DOUBLE AS u FROM documents),
s AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY {CAP} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least({CAP} * source_size::DOUBLE, (SELECT max(level) FROM l) * w) AS target FROM l),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least({CAP}.0, target / source_size) ELSE 0 END AS expected FROM d JOIN t USING (k)),
p AS (SELECT *, floor(expected)::BIGINT AS whole, greatest(1e-9, expected - floor(expected)) AS p FROM e),
q AS (SELECT *, CASE WHEN size > 0 AND whole < {CAP} THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
r AS (SELECT doc_id, k, size, source_size, target, whole, odds / (1 + odds) AS rank FROM q),
m AS (SELECT 0 AS round, true AS go, 0 AS extra, r.* FROM r
  UNION ALL SELECT round + 1, bool_or(add) OVER (), extra + add::INT, doc_id, k, size, source_size, target, whole, rank FROM (
  SELECT *, fits AND sum(size) OVER (PARTITION BY k, fits ORDER BY extra, rank, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap AS add FROM (
  SELECT *, rank IS NOT NULL AND whole + extra < {CAP} AND size <= gap AS fits FROM (
  SELECT *, target - sum(size * (whole + extra)) OVER (PARTITION BY k) AS gap FROM m WHERE go)))),
n AS (SELECT *, target - sum(size * (whole + extra)) OVER (PARTITION BY k) AS gap FROM m WHERE round = (SELECT max(round) FROM m)),
b AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY abs(gap - size), extra, rank, doc_id, size) AS i
  FROM n WHERE rank IS NOT NULL AND whole + extra < {CAP} AND abs(gap - size) < gap) WHERE i = 1),
o AS (SELECT * REPLACE (extra + (doc_id IN (FROM b))::INT AS extra) FROM n)
SELECT doc_id, size, source_size, target, whole + extra AS copies, size * (whole + extra) AS taken FROM o
"""

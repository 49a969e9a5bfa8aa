"""Exact deduplication as a stateful stream with keyed state on disk that never expires.

A stream of digests runs into a RocksDB state store. Per digest of the normalised
text the state keeps the digest, the stable identifier (largest id) with the locator
of the file that holds its content, and the number of rows. State is read back as a
table. Where a digest was hit more than once, the full texts are compared, those of earlier
calls read through their locators; digests that stand for different texts are resolved by the texts themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, heavy_keys, rows_of, stage, stage_path, table

#: State on disk; no space is reserved in advance, as there may be many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # An executor's stores share this much memory, however many there are.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
}
#: Rows of one digest that one task compares, and the part of all rows from which a digest is split.
SPLIT_ROWS, HEAVY_SHARE = 500, 1000


def normalised(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


def absorb(spark: SparkSession, feed: str, schema, state: str) -> DataFrame:
    """Run all new files of ``feed`` into the keyed state at ``state`` and return the state as a table.

    Feed rows are (id, digest, locator). The state lives in the stream's checkpoint
    folder, so a later call with more files only reads those.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        keyed = spark.readStream.schema(schema).parquet(feed).groupBy("digest").agg(
            F.max(F.struct("id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        run = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
        run.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return held_in(spark, state)


def held_in(spark: SparkSession, state: str) -> DataFrame:
    """(digest, keep_id, locator, group_size): the state as a table."""
    return spark.read.format("statestore").load(state).select(
        F.col("key.digest").alias("digest"), F.col("value.max.id").alias("keep_id"),
        F.col("value.max.locator").alias("locator"), F.col("value.count").alias("group_size"))


def collisions(texts: DataFrame, state: DataFrame) -> DataFrame:
    """Digests whose rows differ in their bytes. ``texts``: (digest, body).

    Only digests hit more than once are read; equal texts meet as equal minimum and
    maximum. A digest with a large part of all rows is dealt over many tasks by a salt.
    """
    hits = state.where("group_size > 1").select("digest", "group_size")
    heavy = heavy_keys(state, "digest", "group_size", HEAVY_SHARE).withColumn(
        "parts", F.ceil(F.col("group_size") / SPLIT_ROWS).cast("int")).drop("group_size")
    salted = texts.join(F.broadcast(heavy), "digest", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int"))
    spread = hits.join(F.broadcast(heavy), "digest", "left").select(
        "digest", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("salt"))
    ends = salted.join(spread, ["digest", "salt"], "left_semi").groupBy("digest", "salt").agg(
        F.min("body").alias("lo"), F.max("body").alias("hi"))
    return ends.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("digest")


def has_state(spark: SparkSession, state: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(state, "state")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def earlier_texts(held: DataFrame, feed: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame | None:
    """(id, digest, body, n) of the texts in the state that ``feed`` hits, read from the files their locators name.

    The names of those files pass the driver, as for any read.
    """
    hits = stage(held.join(feed.select("digest").distinct(), "digest", "left_semi").where("locator <> ''"), "dedup-hits")
    files = [unquote(r.locator) for r in hits.select("locator").distinct().collect()]
    if not files:
        return None
    body = normalised(text_col)
    there = feed.sparkSession.read.parquet(*files).select(F.col(id_col).alias("id"), digest(body).alias("digest"), body.alias("body"))
    known = hits.select(F.col("digest").alias("own"), "keep_id", F.col("group_size").alias("n"))
    return there.join(known, (F.col("digest") == F.col("own")) & F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest", "body", "n").dropDuplicates(["digest", "body"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after lower-casing A-Z. The row with the largest id
    stays; a null id is below all others. Null text counts as empty, and empty texts are
    equal. Rows that repeat both id and text carry equal results, all marked kept when
    their id stays. Other columns are not read. An empty table gives no rows. ``state`` is the folder of
    a state to go on from; group sizes and keepers then include all earlier rows. Texts of earlier calls are compared too where these read
    them from Parquet files, which must still be there; of a digest that stood for several texts within earlier calls the state knows one.
    """
    spark = docs.sparkSession
    body = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), digest(body).alias("digest"),
                       F.sha2(body, 256).alias("text_sha256"), F.input_file_name().alias("locator"))
    own_digest = digest is not sha256  # else the digest itself gives text_sha256
    # The stream of a state goes on with the next folder beside those of earlier calls.
    feeds = f"{state.rstrip('/')}-feed" if state else stage_path(spark, "dedup-feed")
    feed_path = f"{feeds}/{uuid.uuid4().hex}"
    feed = rows if own_digest else rows.drop("text_sha256")
    feed.write.parquet(feed_path)
    feed = spark.read.schema(feed.schema).parquet(feed_path)
    before = earlier_texts(held_in(spark, state), feed, id_col, text_col, digest) if state and has_state(spark, state) else None
    before = stage(before, "dedup-earlier") if before is not None else None
    held = absorb(spark, f"{feeds}/*", feed.schema, state or stage_path(spark, "dedup-state"))
    held = stage(held, "dedup-keepers")
    texts = docs.select(F.col(id_col).alias("id"), digest(body).alias("digest"), body.alias("body"))
    clash = stage(collisions(texts.unionByName(before.drop("n")) if before is not None else texts, held), "dedup-clashes")
    sha = F.col("text_sha256") if own_digest else F.lower(F.hex("digest"))
    report = lambda df: df.select(F.col("id").alias(id_col), "keep_id", "group_size",
                                  F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    feed = feed.withColumn("text_sha256", sha)
    if clash.isEmpty():
        return report(feed.join(held, "digest"))
    sure = report(feed.join(clash, "digest", "left_anti").join(held, "digest"))
    unsure = texts.join(clash, "digest", "left_semi").withColumn("text_sha256", F.sha2("body", 256))
    by_text = unsure.select("id", "digest", "body", F.lit(1).cast("long").alias("n"))
    by_text = by_text.unionByName(before.join(clash, "digest", "left_semi")) if before is not None else by_text
    by_text = by_text.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return sure.unionByName(report(unsure.join(by_text, ["digest", "body"])))


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; of rows repeating id and text, one."""
    found = exact_duplicates(docs, id_col, text_col)
    own, keep, digest = fresh(docs, "own_digest", "keep_id", "keep_digest")
    keepers = found.where("kept").select(F.col("keep_id").alias(keep), F.unhex("text_sha256").alias(digest)).distinct()
    return rows_of(docs.withColumn(own, sha256(normalised(text_col))), keepers, {own: digest, id_col: keep}).drop(own)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY b) AS keep_id, count(*) OVER (PARTITION BY b) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY b) AS kept, sha256(b) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM documents)
"""

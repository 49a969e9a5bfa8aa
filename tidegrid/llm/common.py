"""What several operators share: text keys, held-out rows, staged tables, rows of hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the ASCII white space; the same runs as ``bytes.split()``.
ROW_GROUP = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` has a fast path for plain ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod, F.lit(-1))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def id_key(id_col: str, digest: str) -> Column:
    """Id and text digest as one key, null ids after all others."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(digest).alias("digest"))


def rows_of(docs: DataFrame, ids: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``docs`` that match ``ids``, with the other columns of ``ids``; of rows equal in the keys, one.

    ``on`` maps key columns of ``docs`` to those of ``ids``; the last may be null on both sides. Texts are shuffled once: rows with
    a null key are joined apart, so that the join and the choice of one row share a partitioning.
    """
    *safe, last = on
    same = [F.col(k) == F.col(on[k]) for k in safe]
    known = docs.join(ids, [*same, F.col(last) == F.col(on[last])]).dropDuplicates(list(on))
    no_key = ids.where(F.col(on[last]).isNull())
    null = docs.where(F.col(last).isNull()).join(no_key, [*same, F.col(last).eqNullSafe(F.col(on[last]))]).dropDuplicates(list(on))
    return known.unionByName(null).drop(*on.values())


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, deleted when the application ends."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read and read it back; survives lost executors. Row groups are small, as a task holds one while it writes."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy_keys(counts: DataFrame, key: str, n: str, share: int) -> DataFrame:
    """Keys with more than one in ``share`` of all rows: at most ``share`` of them, so safe to broadcast."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) * share > total).select(key, n)

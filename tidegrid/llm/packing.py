"""Best-fit packing of documents into bins, with conflicts between sources and copies.

Bins are kept in the order of what room they have left, each with a bitmap of the sources
and one of the duplicate clusters in it. A document goes to the tightest bin with enough
room; where that bin has its source or its cluster, the search goes on to the successor until a
bin is compatible, or a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, heavy_keys, stage, table, word_count

#: Words in a bin, and rows that are packed together. Shards are independent, so their number grows with the input.
CAPACITY, SHARD_ROWS = 2048, 4096
#: An id with more than one in so many of all rows is dealt out by row, not by id.
HEAVY_SHARE = 1000


def best_fit(items: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """Pack one shard. ``items``: (key, size, source, cluster); returns (key, piece, words, word_start, bin, bin_start).

    Largest first, ties by position in ``items``. What exceeds the capacity fills whole bins of its own; the
    remainder is packed. Items of size 0 get bin None.
    """
    def bits(values):
        often = (v for v, n in Counter(values).items() if n > 1)  # one that is alone can't conflict
        return {v: 1 << i for i, v in enumerate(often)}

    source_bit, cluster_bit = bits(i[2] for i in items), bits(i[3] for i in items)
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    placed = []

    def new_bin():
        sources.append(0)
        clusters.append(0)
        return len(sources) - 1

    rests = []
    for at, (key, size, _, _) in enumerate(items):
        whole, rest = divmod(size, capacity)
        for piece in range(whole):
            placed.append((key, piece, capacity, piece * capacity, new_bin(), 0))
        if rest:
            rests.append((-rest, at, whole))
        elif not whole:
            placed.append((key, 0, 0, 0, None, None))
    for neg, at, piece in sorted(rests):
        key, _, source, cluster = items[at]
        size, s, c = -neg, source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        pos = bisect_left(room, (size, -1))
        while pos < len(room) and (sources[room[pos][1]] & s or clusters[room[pos][1]] & c):
            pos += 1
        left, bin_no = room.pop(pos) if pos < len(room) else (capacity, new_bin())
        sources[bin_no] |= s
        clusters[bin_no] |= c
        if left > size:
            insort(room, (left - size, bin_no))
        placed.append((key, piece, size, piece * capacity, bin_no, capacity - left))
    return placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster_col: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, source, cluster, piece, n_words, word_start, bin_id, bin_start.

    A document of up to ``capacity`` words is one piece; a longer one is cut into full pieces, each a
    bin of its own, and a remainder. A bin holds at most ``capacity`` words, and at most one
    document of a source and of a duplicate cluster. ``cluster_col`` names a column with clusters; without it documents with
    equal texts but for A-Z case are a cluster. A null source or cluster is a value like others. Rows without words (null or
    empty texts) get one piece of 0 words with null bin. Repeated rows are packed one by one. An empty table gives no rows.

    Rows are dealt by the hash of their id over as many shards as the input needs; a shard is about ``shard_rows``
    narrow rows, packed in one task. Rows of an id that is very frequent are dealt one by one.
    """
    spark = docs.sparkSession
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    rows = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                             cluster.alias("cluster"), F.monotonically_increasing_id().alias("row")), "pack-sizes")
    shards = max(1, -(-rows.count() // shard_rows))
    heavy = heavy_keys(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "id", "n", HEAVY_SHARE).withColumnRenamed("id", "heavy")
    dealt = rows.join(F.broadcast(heavy), F.col("id").eqNullSafe(F.col("heavy")), "left")
    shard = F.pmod(F.when(F.col("n").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("id", "row")), F.lit(shards))
    dealt = dealt.select("id", "source", "size", "cluster", shard.alias("shard"))

    def run(key, t):
        sizes, sources, clusters, ids = (t.column(c).to_pylist() for c in ("size", "source", "cluster", "id"))
        order = sorted(range(t.num_rows), key=lambda i: (-sizes[i], clusters[i], str(sources[i]), str(ids[i])))
        got = best_fit([(i, sizes[i], sources[i], clusters[i]) for i in order], capacity)
        take = pa.array([g[0] for g in got], pa.int64())
        base = key[0].as_py() << 32
        columns = [t.column(c).take(take) for c in ("id", "source", "cluster")]
        columns += [pa.array([g[j] for g in got], pa.int64()) for j in (1, 2, 3)]
        columns += [pa.array([None if g[4] is None else base + g[4] for g in got], pa.int64()), pa.array([g[5] for g in got], pa.int64())]
        return pa.table(columns, names)

    names = [id_col, source_col if source_col != "cluster" else "source", "cluster", "piece", "n_words", "word_start", "bin_id", "bin_start"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"`{names[0]}` {kind['id']}, `{names[1]}` {kind['source']}, cluster long, piece long, n_words long, word_start long, bin_id long, bin_start long"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""Embedding near-duplicates through a pivot-permutation index.

Equal vectors are taken together first. A vector is described by its nearest reference points in order. Inverted lists are kept for
every set of ``SHARED`` pivots out of a vector's nearest, ``PREFIX`` or more with many pivots, so vectors that meet in a list
share at least that many. Lists hold row numbers; those with one row go before vectors are joined. Vectors of a list are verified by
their cosine in double precision, many short lists at once; a pair that meets in several lists counts only in the first. Long lists
are dealt as pairs of blocks. Tasks return link counts and spanning links, never all pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .components import connected_components

THRESHOLD = 0.95
#: Least number of nearest pivots that describe a vector, and how many two vectors must share to meet.
PREFIX, SHARED = 6, 3
#: Numbers of pivots beyond which one more of the nearest describes a vector, so that pairs at the threshold meet as often.
LONGER = (128, 256, 1024, 4096, 8192)
#: Pivots grow with the cube root of the number of vectors, so that lists stay as long; bounds and rows looked at for each.
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS, TRIED = 7, 64, 16384, 4
#: Two pivots have a cosine below this, so similar vectors don't fill the set.
APART = 0.7
#: Vectors in a block of a list; rows of short lists verified together; numbers in a matrix held at once.
BLOCK, TOGETHER, CELLS = 512, 16384, 1 << 20
#: Bits of a pivot's number in the key of a list.
PIVOT_BITS = 20


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their unit vectors in double precision). Null, zero, non-finite, or null components, or
    another length than ``dim`` are not usable."""
    good = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dim)
    x = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null components become NaN
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # very long or short vectors keep a finite norm
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    fine = np.isfinite(x).all(axis=1)
    return good[fine], x[fine]


def choose_pivots(vectors: DataFrame, dim: int, n: int) -> np.ndarray:
    """Reference points out of a bounded sample of the ``n`` distinct vectors by their hash, far apart from each other."""
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PER_ROOT * n ** (1 / 3))))
    part = 2.0 * TRIED * wanted / max(n, 1)
    drawn = vectors.where(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < part)
    rows = drawn.select("vec", "h").limit(4 * TRIED * wanted).toArrow()
    order = np.argsort(rows.column("h").to_numpy(), kind="stable")
    at, unit = unit_rows(rows.column("vec").take(pa.array(order)).combine_chunks(), dim)
    chosen, found = np.zeros((wanted, dim)), 0
    for v in unit:
        if found < wanted and (not found or (chosen[:found] @ v).max() < APART):
            chosen[found] = v
            found += 1
    return chosen[:found]


def prefix_length(pivots: int) -> int:
    return min(PREFIX + sum(pivots > n for n in LONGER), pivots)


def permutation_prefixes(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first; ties by number."""
    k, step = prefix_length(len(pivots)), max(1, CELLS // len(pivots))
    parts = [np.zeros((0, k), dtype=np.int64)]
    for at in range(0, len(unit), step):
        far = -(unit[at:at + step] @ pivots.T)
        near = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
        parts.append(np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(parts)


def list_pairs(starts: np.ndarray, sizes: np.ndarray, across: np.ndarray, blocks: np.ndarray, unit: np.ndarray, threshold: float):
    """(a, b): places of pairs within a list whose cosine reaches the threshold, in parts; lists of one size at a time.

    A list ``across`` two blocks yields only pairs with one end in each.
    """
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = np.flatnonzero(sizes == size)
        step = max(1, CELLS // (size * size))
        for at in range(0, len(own), step):
            lists = own[at:at + step]
            rows = starts[lists][:, None] + np.arange(size)
            x, block = unit[rows], blocks[rows]
            near = np.triu(x @ x.transpose(0, 2, 1) >= threshold, 1)
            near &= ~across[lists][:, None, None] | (block[:, :, None] != block[:, None, :])
            which, a, b = np.nonzero(near)
            yield rows[which, a], rows[which, b]


def links_of(rows: np.ndarray, times: np.ndarray, last: np.ndarray, starts: np.ndarray, across: np.ndarray, blocks: np.ndarray, unit: np.ndarray, tops: np.ndarray,
             threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of lists that lie end to end: (rows, number of links, smallest row reached here).

    ``times`` says how many vectors a row stands for, ``last`` is the largest pivot of its list's key. A pair belongs to the list whose key
    holds its smallest shared pivots.
    """
    ends = []
    for a, b in list_pairs(starts, np.diff(np.append(starts, len(rows))), across, blocks, unit, threshold):
        shared = np.zeros(len(a), dtype=np.int64)
        for c in range(tops.shape[1]):
            own = tops[a, c]
            shared += (own <= last[a]) & (tops[b] == own[:, None]).any(axis=1)
        first = shared == min(SHARED, tops.shape[1])
        ends.append((a[first], b[first]))
    if not ends:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    a, b = (np.concatenate(e) for e in zip(*ends))
    nodes, at = np.unique(np.concatenate([rows[a], rows[b]]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    counts = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(counts, u, times[b])
    np.add.at(counts, v, times[a])
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return nodes, counts, nodes[label]
        label = low


def _dealt_lists(lists: DataFrame) -> DataFrame:
    """(row, key, i, j, block): rows of lists with two or more rows; of long lists for each pair of blocks."""
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = lists.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = met.select("row", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    return other.select("row", "key", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))


def _verified(dealt: DataFrame, threshold: float, dim: int) -> DataFrame:
    """(row, links, root) from lists with vectors; whole lists, or pairs of blocks, are held until they are many enough."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def marks(b):
            return np.column_stack([b.column(c).to_numpy() for c in ("key", "i", "j")])

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            mark = marks(t)
            starts = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]).any(axis=1)))
            _, unit = unit_rows(t.column("vec").combine_chunks(), dim)
            tops = t.column("top").combine_chunks().flatten().to_numpy().reshape(len(unit), -1)
            got = links_of(t.column("row").to_numpy(), t.column("times").to_numpy(), mark[:, 0] & ((1 << PIVOT_BITS) - 1), starts,
                           mark[starts, 1] != mark[starts, 2], t.column("block").to_numpy(), unit, tops, threshold)
            return pa.record_batch([pa.array(x, pa.int64()) for x in got], ["row", "links", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            if sum(h.num_rows for h in held) + b.num_rows < TOGETHER:
                held.append(b)
                continue
            mark = marks(b)
            edges = np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1
            if held and (marks(held[-1].slice(held[-1].num_rows - 1))[0] != mark[0]).any():
                edges = np.append(0, edges)
            if not len(edges):  # all of one list
                held.append(b)
                continue
            whole = int(edges[-1])
            if whole:
                held.append(b.slice(0, whole))
            yield flush()
            held.append(b.slice(whole))
        if held:
            yield flush()

    own = ("key", "i", "j")
    return dealt.repartition(*own).sortWithinPartitions(*own).mapInArrow(run, "row long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Links are the pairs found with a cosine of at least ``threshold`` in double precision; ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id reachable, itself included. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, nor do vectors of another length than most.
    Repeated rows are rows of their own and link with each other; equal vectors are searched once, however many there are.
    Other columns, such as labels, are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stage(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.xxhash64(vec_col).alias("h")), "vectors")
    lengths = rows.where("size(vec) > 0").groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), "dim").first()
    dim = usual.dim if usual else 1
    # The hash stands first, so that vectors are compared only where it agrees.
    groups = rows.where(F.size("vec") == dim).groupBy("h", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("times"))
    groups = stage(groups.withColumn("row", F.monotonically_increasing_id()), "distinct-vectors")
    pivots = spark.sparkContext.broadcast(choose_pivots(groups, dim, groups.count()))
    if not len(pivots.value):
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    def describe(batches):
        for b in batches:
            good, unit = unit_rows(b.column(2), dim)
            at = pa.array(good)
            tops = permutation_prefixes(unit, pivots.value)
            top = pa.ListArray.from_arrays(pa.array(np.arange(len(tops) + 1, dtype=np.int32) * tops.shape[1]), pa.array(tops.ravel().astype(np.int32)))
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), top], ["row", "times", "vec", "top"])

    kind = rows.schema["vec"].dataType.simpleString()
    described = stage(groups.select("row", "times", "vec").mapInArrow(describe, f"row long, times long, vec {kind}, top array<int>"), "permutations")
    k = prefix_length(len(pivots.value))
    ordered = F.col("ordered")
    keys = [reduce(lambda key, i: F.shiftleft(key, PIVOT_BITS) + F.get(ordered, F.lit(i)), c, F.lit(0).cast("long")) for c in combinations(range(k), min(SHARED, k))]
    lists = described.select("row", F.array_sort("top").alias("ordered")).select("row", F.explode(F.array(*keys)).alias("key"))
    dealt = _dealt_lists(lists).join(described, "row")
    found = stage(_verified(dealt, threshold, dim), "vector-links")
    counts = found.groupBy("row").agg(F.sum("links").alias("near"))
    reached = connected_components(found, "row", "root").withColumnRenamed("node", "row")
    labelled = described.select("row", "times").join(groups.select("row", "h", "vec", "low"), "row").join(counts, "row", "left").join(reached, "row", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "row"))
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    results = labelled.join(lowest, "component").select(
        "h", F.col("vec").alias("own_vec"), (F.coalesce("near", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    results = stage(results.withColumnRenamed("h", "own_h"), "vector-results")
    full = rows.join(results, (F.col("h") == F.col("own_h")) & (F.col("vec") == F.col("own_vec")), "left")
    component = F.coalesce("component_id", "id")
    return full.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.col("id").eqNullSafe(component).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
r AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT n, min(m) AS component_id FROM r GROUP BY n) c ON c.n = v.vec_id
"""

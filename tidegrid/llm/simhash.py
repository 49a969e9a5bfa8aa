"""SimHash near-duplicates through pivot distance tables.

Every fingerprint gets a table of Hamming distances to fixed reference fingerprints.
Two fingerprints that differ in d bits differ by at most d in every entry. The table is
also kept for parts of the bits: of four parts, two fingerprints within two bits agree on at
least two, and there every entry differs by 0. So pairs meet on equal entries over two parts,
pairs with an entry of the whole table further apart than the limit are discarded, and the
survivors are verified bit by bit.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, id_key, rows_of, stage, table, text_digest
from .components import connected_components

SEED, SHINGLE, LIMIT, BITS = 42, 3, 2, 64
#: Number of reference fingerprints. They come from a rule: the hashes of 0, 1, 2, ...
REFERENCES = 24
PARTS = 4
#: Fingerprints that may meet on one key before the key is made finer.
MEETING = 48
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def reference(j: int) -> int:
    """Reference fingerprint j as a signed 64-bit number."""
    h = xxhash.xxh64_intdigest(str(j).encode(), SEED)
    return h - (1 << BITS) if h >> (BITS - 1) else h


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of one whole text; 0 where it has no word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    stop, starts, ends = 0, [], []
    for w in words:
        starts.append(stop)
        stop += len(w) + 1
        ends.append(stop - 1)
    ends = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at:min(at + BLOCK, n)], ends[at:at + BLOCK])
        hashes = np.array([digest(joined[s:e], seed) for s, e in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): fingerprint of every row as a signed long."""

    def run(batches):
        for b in batches:
            out = [fingerprint(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def part_key(fp: Column, bits: list[int]) -> Column:
    """Distances to all references over the given bits, as one hash. Equal bits give equal
    keys; what else shares a key is discarded later."""
    mask = sum(1 << i for i in bits)
    mask = mask - (1 << BITS) if mask >> (BITS - 1) else mask
    return F.xxhash64(F.lit(mask), *[F.bit_count(fp.bitwiseXOR(F.lit(reference(j))).bitwiseAND(F.lit(mask))) for j in range(REFERENCES)])


def coarse_keys(bits: list[int], limit: int, parts: int = PARTS) -> list[tuple[list[int], list[int]]]:
    """(agreeing bits, remaining bits) for each way to choose the parts that agree.

    With ``parts`` parts of ``bits`` and at most ``limit`` differing bits, ``parts - limit``
    of them agree whole.
    """
    cut = [bits[i * len(bits) // parts:(i + 1) * len(bits) // parts] for i in range(parts)]
    picks = combinations(range(parts), parts - limit)
    return [(sum((cut[i] for i in p), []), sum((c for i, c in enumerate(cut) if i not in p), [])) for p in picks]


def _levels(limit: int) -> list[list[tuple[list[int], list[int]]]]:
    """Keys for each level: every key of a level refines one of the level before."""
    levels = [coarse_keys(list(range(BITS)), limit)]
    while len(levels[-1][0][1]) > 2 * PARTS:
        levels.append([(same + more, rest) for same, left in levels[-1] for more, rest in coarse_keys(left, limit)])
    return levels


def near_pairs(distinct: DataFrame, limit: int = LIMIT, meeting: int = MEETING) -> DataFrame:
    """(a, b): all pairs a < b of the distinct fingerprints ``fp`` within ``limit`` bits.

    Keys on which more than ``meeting`` fingerprints meet are made finer, level by level;
    on the last level only a few bits are free, which bounds who can meet (256 for a limit of 2). A fingerprint
    has at most 2,080 partners within two bits, so the number of pairs is in proportion to
    the number of fingerprints, however large a group of near copies is.
    """
    if not 0 <= limit < PARTS:
        raise ValueError(f"limit must be from 0 to {PARTS - 1}")
    levels, waiting, found = _levels(limit), None, []
    coords = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(reference(j)))).cast("byte") for j in range(REFERENCES)])
    for depth, keys in enumerate(levels):
        wide = distinct if waiting is None else waiting
        per = len(keys) if waiting is None else len(keys) // len(levels[depth - 1])
        if waiting is None:
            options = F.array(*[F.struct(F.lit(i).alias("i"), part_key(F.col("fp"), same).alias("key")) for i, (same, _) in enumerate(keys)])
        else:  # only the keys that refine the one on which too many met
            cases = F.when(F.lit(False), None)
            for parent in range(len(levels[depth - 1])):
                own = range(parent * per, (parent + 1) * per)
                cases = cases.when(F.col("i") == parent, F.array(*[F.struct(F.lit(i).alias("i"), part_key(F.col("fp"), keys[i][0]).alias("key")) for i in own]))
            options = cases
        keyed = wide.select("fp", F.explode(options).alias("o")).select("fp", "o.i", "o.key")
        last = depth == len(levels) - 1
        keyed = stage(keyed, "pivot-keys")
        sizes = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        near = sizes if last else sizes.where(F.col("n") <= meeting)
        rows = keyed.join(near.select("i", "key"), ["i", "key"]).select("i", "key", "fp", coords.alias("table"))
        left, right = rows.alias("l"), rows.alias("r")
        apart = reduce(F.greatest, [F.abs(F.col("l.table")[j] - F.col("r.table")[j]) for j in range(REFERENCES)])
        pairs = left.join(right, (F.col("l.i") == F.col("r.i")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
                          & (apart <= limit) & (distance(F.col("l.fp"), F.col("r.fp")) <= limit))
        found.append(pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")))
        if last:
            break
        crowded = sizes.where(F.col("n") > meeting).select("i", "key")
        waiting = stage(keyed.join(crowded, ["i", "key"]).select("fp", "i"), "pivot-crowded")
        if waiting.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    A component holds all rows reachable over links of at most ``limit`` differing bits; its
    id is the smallest id in it. Null and empty texts have fingerprint zero and link
    like others. Equal fingerprints, such as those of repeated rows, count once in the search. Null ids are ignored
    in the smallest id. Other columns are not read. An empty table gives no rows.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    reached = connected_components(near_pairs(distinct.select("fp"), limit), "a", "b")
    labelled = distinct.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    ids = stage(labelled.join(lowest, "label").select("fp", "component_id"), "components")
    return rows.join(ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: of those with its smallest id (null only where all are null), the text with the smallest digest."""
    key, digest, keep, keep_digest = fresh(docs, "key", "digest", "keep_id", "keep_digest")
    known = docs.withColumn(digest, text_digest(text_col))
    found = near_duplicates(known.select(id_key(id_col, digest).alias(key), text_col), key, text_col)
    stay = found.where(F.col(key) == F.col("component_id")).select(F.col(key)["id"].alias(keep), F.col(key)["digest"].alias(keep_digest)).distinct()
    return rows_of(known, stay, {digest: keep_digest, id_col: keep}).select(*docs.columns)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

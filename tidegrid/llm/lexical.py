"""Ranked lexical search of a stated set of items over all documents, by bag deduplication.

Documents are cut down to the vocabulary of the items: a bag of (term, count) pairs and a length class m. Documents
with the same bag and the same m score alike for every item, so they form a class, found by a hash and
verified by the bag itself. Classes are scored once and expanded to their members by ascending id.

Items come in blocks of bounded size, so that the vocabulary and the item-term matrix that travel to the tasks are bounded too.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, stage, table

#: Code points outside of these ranges belong to terms.
OUTSIDE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TOP = 50
#: Term occurrences of items in a block; floats of a task's score and bag matrices.
BLOCK_TERMS, MATRIX = 200_000, 4_000_000
_TERMS = re.compile(f"[^{OUTSIDE}]+").findall
_FOLD = str.maketrans(UPPER, LOWER)


def _terms(text: str | None) -> list[str]:
    return _TERMS(text.translate(_FOLD)) if text else []


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, terms): distinct terms of each item."""
    found = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"([^{OUTSIDE}]+)"))
    return items.select(F.col(item_col).alias("item"), F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))).alias("terms"))


def bags(docs: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, bag) of every document with a term. ``bag``: int32 pairs of word number and count, by word number."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches):
        number = shared.value
        for b in batches:
            keep, sizes, packed = [], [], []
            for i in range(b.num_rows):  # one text at a time, so that a batch of long texts is not held as terms
                counts = Counter(_terms(b.column(1)[i].as_py()))
                if counts:
                    keep.append(i)
                    sizes.append(sum(counts.values()))
                    packed.append(np.array(sorted((number[w], counts[w]) for w in counts.keys() & number.keys()), dtype="<i4").tobytes())
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["id", "n", "bag"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n long, bag binary")


def _unpack(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and count of all pairs in a batch of bags."""
    raw = column.to_pylist()
    pairs = np.frombuffer(b"".join(raw), dtype="<i4").reshape(-1, 2)
    return np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw]), pairs[:, 0], pairs[:, 1].astype(np.int64)


def document_counts(rows: DataFrame, n_words: int) -> DataFrame:
    """(word, df): documents that hold each word, added up by task before anything is shuffled."""
    def run(batches):
        total = np.zeros(n_words, dtype=np.int64)
        for b in batches:
            total += np.bincount(_unpack(b.column(0))[1], minlength=n_words)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], ["word", "df"])

    return rows.select("bag").mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))


def _best(item: np.ndarray, score: np.ndarray, first: np.ndarray, row: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each item the ``k`` highest scores, equal ones by the smaller ``first``."""
    order = np.lexsort((first, -score, item))
    item = item[order]
    begin = np.append(True, item[1:] != item[:-1])
    at = np.arange(len(item))
    rank = at - np.maximum.accumulate(np.where(begin, at, 0))
    order = order[rank < k]
    return [item[rank < k], score[order], first[order], row[order]]


def score_classes(classes: DataFrame, weights: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    """(item, score, hash, m, bag): per task the ``k`` best classes of each item; ``matrix`` has a row per word, a column per item.

    All sums are of whole numbers below 2**53, so they are exact in floats and independent of order.
    """
    shared = classes.sparkSession.sparkContext.broadcast((weights, matrix))

    def run(batches):
        weight, has = shared.value
        n_words, n_items = has.shape
        step = max(1, MATRIX // max(n_words, n_items, 1))
        top, kept, keys = [np.zeros(0, np.int64)] * 4, {}, 0
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                row, word, tf = _unpack(part.column(2))
                m = np.asarray(part.column(1))
                impact = np.zeros((part.num_rows, n_words))
                impact[row, word] = weight[word] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                scores = impact @ has
                # Only what could still be among an item's best leaves the matrix: k rows of this part, and all ties with the last.
                if len(scores) > k:
                    bound = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
                    r, c = np.nonzero((scores >= bound) & (scores > 0))
                else:
                    r, c = np.nonzero(scores > 0)
                # A null id comes last.
                first = np.asarray(part.column(3).fill_null(np.iinfo(np.int64).max))
                new = [c, scores[r, c].astype(np.int64), first[r], r + keys]
                top = _best(*(np.concatenate(p) for p in zip(top, new)), k)
                at = set(top[3].tolist())
                kept = {i: v for i, v in kept.items() if i in at}
                fresh = [i for i in at if i >= keys]
                kept.update(zip(fresh, part.take(pa.array([i - keys for i in fresh], pa.int64())).to_pylist()))
                keys += part.num_rows
        rows = [kept[i] for i in top[3].tolist()]
        columns = [pa.array(top[0]), pa.array(top[1])] + [pa.array([r[c] for r in rows], t) for c, t in (("hash", pa.int64()), ("m", pa.int64()), ("bag", pa.binary()), ("first", pa.int64()))]
        yield pa.record_batch(columns, ["number", "score", "hash", "m", "bag", "first"])

    return classes.select("hash", "m", "bag", "first").mapInArrow(run, "number long, score long, hash long, m long, bag binary, first long")


def _first_rows(df: DataFrame, keys: list, order: list, k: int, out: str) -> DataFrame:
    """The first ``k`` rows of each key; a limit on row numbers is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each item, equal scores by ascending id.

    Terms are runs of digits, ASCII letters and everything above ASCII, with A-Z lower-cased; a term of an item counts once. Null
    and empty texts have no terms: such items have no rows, such documents appear nowhere and count in no statistic. Documents
    with repeated ids, or repeated rows, are ranked each; null ids come last among equal scores. Item rows with the same
    id are one item with the terms of all. Other columns are not read; empty tables give no rows. Texts of
    any length are read whole. Ids of documents must be integers.

    Items are dealt into blocks by hash, so that a block has about ``block_terms`` terms and words times items stay below ``MATRIX``;
    each block is one pass over the documents. The driver holds one block of items at a time, never anything of documents but counts
    by vocabulary term.
    """
    asked = item_terms(items, item_col, item_text_col)
    asked = stage(asked.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0), "items")
    size = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms"), F.count(F.lit(1)).alias("items")).first()
    n_blocks = max(math.ceil(size["terms"] / block_terms), math.ceil(math.sqrt(size["terms"] * size["items"] / MATRIX)))
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item {item_kind}, rank int, id {id_kind}, score long")
    for block in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).orderBy("item").collect()
        if part:
            found = _search_block(docs, [(r["item"], r["terms"]) for r in part], item_kind, id_col, text_col, k)
            out = found if n_blocks == 1 else out.unionByName(found)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(docs: DataFrame, asked: list[tuple], item_kind: str, id_col: str, text_col: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    words = sorted({w for _, terms in asked for w in terms})
    number = {w: i for i, w in enumerate(words)}
    rows = stage(bags(docs, words, id_col, text_col), "bags")
    size = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    counts = {r["word"]: r["df"] for r in document_counts(rows, len(words)).collect()}
    df = np.array([counts.get(i, 0) for i in range(len(words))], dtype=np.float64)
    weights = np.floor(1000 * np.log((2 * size["n_docs"] + 2) / (2 * df + 1))).astype(np.int64)
    has = np.zeros((len(words), len(asked)))
    for j, (_, terms) in enumerate(asked):
        has[[number[w] for w in terms], j] = 1.0

    m = F.expr(f"50 + ((50 * n * {size['n_docs']}L) div {size['n_terms'] or 1}L)")
    classed = rows.where(F.octet_length("bag") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("m", "bag"))
    # Members of a class beyond the k-th smallest id can be in no result. The bag in the key verifies the hash.
    members = stage(_first_rows(classed.select("hash", "m", "bag", "id"), ["hash", "m", "bag"], [F.col("id").asc_nulls_last()], k, "nth"), "classes")
    classes = members.where("nth = 1").withColumn("first", F.col("id").cast("long"))
    best = score_classes(classes, weights, has, k)
    best = _first_rows(best, ["number"], [F.col("score").desc(), F.col("first").asc_nulls_last()], k, "place").drop("first", "place")
    full = best.join(members, ["hash", "m", "bag"]).select("number", "score", "id")
    ranked = _first_rows(full, ["number"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k, "rank")
    names = spark.createDataFrame([(j, item) for j, (item, _) in enumerate(asked)], f"number long, item {item_kind}")
    return ranked.join(F.broadcast(names), "number").select("item", "rank", "id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LIST = "regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^{outside}]+')"
SQL = f"""WITH d AS (SELECT doc_id, {_LIST} AS terms FROM documents),
    i AS (SELECT DISTINCT item_id, unnest({_LIST}) AS term FROM benchmark),
    s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2e0 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
    a AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS part FROM tf JOIN w USING (term), s),
    r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN a USING (term) GROUP BY ALL HAVING sum(part) > 0)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}""".replace("{upper}", UPPER).replace("{lower}", LOWER).replace("{outside}", OUTSIDE)

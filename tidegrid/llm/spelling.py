"""Spelling variants: words of a vocabulary that differ by one letter, and the frequent form behind each.

Distinct words meet in blocks. Two words at distance one agree outside of a window of positions that holds the
error, so a word stands in the blocks of its two halves, once as the shorter and once as the longer of a pair.
A crowded block is split by halving its window, down to one position, where the alphabet bounds it. In a block the
words are numbered, a bitset for each (position, letter) says which have it there, and recurrences over the
letters of a word carry the set without an error and the sets with one, for all words of the block at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import methodcaller

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stage, table

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, FEWEST, TIMES, MODULUS = 7, 2, 10, 31
#: Words of a block above which its window is halved; distinct words a task counts before it sends them on; texts read run by run.
CROWDED, HELD, LONG_TEXT = 4096, 200_000, 1_000_000
_RUN, _CAPITALS = re.compile(f"[{LETTERS}]+"), re.compile("[A-Z]+")


def _runs(text: str) -> Counter:
    """Lower-cased runs of a text and how often each occurs."""
    if len(text) > LONG_TEXT:
        found = Counter(map(methodcaller("group"), _RUN.finditer(text)))
        low: Counter = Counter()
        for run, n in found.items():
            low[_CAPITALS.sub(lambda m: m[0].lower(), run)] += n
        return low
    return Counter(_RUN.findall(text.lower() if text.isascii() else _CAPITALS.sub(lambda m: m[0].lower(), text)))


def _as_written(doc: str, run: str, modulus: int) -> str:
    """The run, short of one letter where the checksum of document and run says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST,
                modulus: int = MODULUS) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur ``fewest`` times or more, counted by task before the shuffle."""
    def run(batches):
        total: Counter = Counter()

        def flush():
            rows = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if text:
                    doc = b.column(0)[i].as_py() or ""
                    for word, n in _runs(text).items():
                        if len(word) >= shortest:
                            written = _as_written(doc, word, modulus)
                            if len(written) >= shortest:
                                total[written] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


KEY = ["size", "lo", "hi", "rest"]


def _windowed(words: DataFrame, windows) -> DataFrame:
    """Rows of blocks. ``windows``: array of structs (size, lo, hi); ``rest`` is what lies outside of the window."""
    rows = words.withColumn("_w", F.explode(windows)).select("word", "n", "_w.*")
    return rows.withColumn("rest", F.expr("concat(left(word, lo), right(word, size - hi))"))


def blocks(words: DataFrame, shortest: int = SHORTEST, crowded: int = CROWDED) -> DataFrame:
    """(size, lo, hi, rest, word, n): blocks in which every pair of words at distance one meets, none above a bound.

    ``size`` is the length of a block's shorter words; the longer ones have one letter more. A block holds at most
    ``crowded`` words unless its window is a single position: then it has as many as there are letters and pairs of letters.
    """
    halves = "struct({0} AS size, 0 AS lo, {0} div 2 AS hi), struct({0} AS size, {0} div 2 AS lo, {0} AS hi)"
    own, less = halves.format("length(word)"), halves.format("(length(word) - 1)")
    rows = _windowed(words, F.expr(f"CASE WHEN length(word) > {shortest} THEN array({own}, {less}) ELSE array({own}) END"))
    rows = rows.withColumns({c: F.col(c).cast("int") for c in KEY[:3]})
    while True:
        full = stage(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("held")).where((F.col("held") > crowded) & (F.col("hi") - F.col("lo") > 1)).select(*KEY), "crowded")
        if not full.take(1):
            return rows
        mid = "((lo + hi) div 2)"
        parts = F.expr(f"array(struct(size, lo, CAST({mid} AS INT) AS hi), struct(size, CAST({mid} AS INT) AS lo, hi))")
        split = rows.join(full, KEY, "left_semi").withColumn("_w", F.explode(parts)).select("word", "n", "_w.*")
        split = split.withColumn("rest", F.expr("concat(left(word, lo), right(word, size - hi))"))
        rows = stage(rows.join(full, KEY, "left_anti").unionByName(split), "blocks")


def near_in_block(size: int, lo: int, hi: int, words: list[str]) -> list[int]:
    """For each word of a block the bitset of words at distance one that this window answers for.

    A word of ``size`` letters is near words of its length or one more, a longer word near shorter ones. An inserted letter is counted at
    the first place where the two words differ, so that a pair is found in one window only.
    """
    has: dict[tuple[int, str], int] = {}
    short = long = 0
    parts = []
    for i, w in enumerate(words):
        bit = 1 << i
        if len(w) == size:
            short |= bit
            parts.append(w[lo:hi])
        else:
            long |= bit
            parts.append(w[lo:hi + 1])
        for p, c in enumerate(parts[-1]):
            has[p, c] = has.get((p, c), 0) | bit
    every, at, last = short | long, has.get, hi == size
    out = []
    for w, part in zip(words, parts):
        same, before, replaced, skipped, inserted = every, every, 0, 0, 0
        for p, c in enumerate(part):
            here, before = at((p, c), 0), same
            replaced = (replaced & here) | (same & ~here)
            skipped = (skipped & at((p - 1, c), 0)) | same
            inserted = (inserted | same) & at((p + 1, c), 0)
            same &= here
        if len(w) == size:
            # Where all letters of the window agree, the other's extra letter is behind it: at its very end, or for the next window.
            more = (inserted | same if last else inserted & ~same) & long
            out.append((replaced & short) | more)
        else:
            out.append((skipped if last else skipped & ~before) & short)
    return out


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): number of near words and the most frequent one, ties by code point."""
    def answer(key, block):
        # Ordered by what makes a form, so the first bit of a set is the best word.
        block.sort(key=lambda r: (-r[1], r[0]))
        if len(block) < 2:
            return
        for (word, _), near in zip(block, near_in_block(*key, [w for w, _ in block])):
            if near:
                form, n = block[(near & -near).bit_length() - 1]
                yield word, near.bit_count(), form, n

    def run(batches):
        key, block, out = None, [], []
        for b in batches:
            for *k, word, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        out.extend(answer(key[:3], block))
                    key, block = k, []
                block.append((word, n))
            if out:
                yield _pairs(out)
                out = []
        if key is not None:
            out.extend(answer(key[:3], block))
        yield _pairs(out)

    def _pairs(out):
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "form", "form_n"])

    ordered = rows.select(*KEY, "word", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    found = ordered.mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms. A form is at least twice as frequent as its word, so chains are short and end;
    each round doubles the steps taken."""
    up = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stage(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not up.where("moved").take(1):
            return up.select("word", "root")
        up = up.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST,
                      times: int = TIMES, modulus: int = MODULUS, crowded: int = CROWDED) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of ASCII letters and U+00C0 to U+00FF with A-Z lower-cased; where ``modulus`` divides the checksum of
    ``id:run``, one letter is left out. ``form`` is the most frequent word at distance one (one letter inserted,
    deleted or replaced) if it is ``times`` (two or more) times as frequent. Null and empty texts have no words, a null id counts as
    empty text in the checksum, rows that repeat count each, other columns are not read; an empty table gives no rows. Texts
    of any length are read whole. No pair of words becomes a row: a block gives one row per word with its count and best form.
    """
    words = stage(word_counts(docs, id_col, text_col, shortest, fewest, modulus), "words")
    near = near_words(blocks(words, shortest, crowded))
    often = F.col("form_n") >= times * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                    F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n"))
    known = stage(known, "near-words")
    roots = last_forms(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


_STEP = "CASE WHEN {0} % 2 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
SQL = f"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, {_STEP.format('c')} FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run
        FROM documents) WHERE length(run) >= {SHORTEST} GROUP BY ALL),
    sums AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 1 + length(hex(encode(doc_id || ':' || run))) // 2),
            lambda j: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), CAST(2 * j - 1 AS INT), 2) AS BIGINT))),
            lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM runs, crc),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {MODULUS} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
        ELSE run END AS word FROM sums) WHERE length(word) >= {SHORTEST} GROUP BY 1 HAVING sum(n) >= {FEWEST}),
    holes AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM words, (SELECT CAST(i AS INT) AS i FROM range(1000) r(i)) WHERE i < length(word)),
    less AS (SELECT DISTINCT word, n, a || b AS short FROM holes),
    pairs AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION ALL SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON w.word = l.short
        UNION ALL SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON w.word = l.short),
    best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1),
    known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n
        FROM words w LEFT JOIN best USING (word)),
    chain AS (SELECT word, form AS root, 1 AS k FROM known WHERE form IS NOT NULL UNION ALL SELECT c.word, s.form, k + 1 FROM chain c JOIN known s ON s.word = c.root WHERE s.form IS NOT NULL),
    roots AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY 1)
    SELECT k.word, form, coalesce(root, k.word) AS root, n, n_near, form_n FROM known k LEFT JOIN roots r ON r.word = k.word"""

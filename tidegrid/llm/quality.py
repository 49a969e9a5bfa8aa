"""Quality of documents by a sparse ensemble of rules.

Boosted trees over text statistics are grown on a bounded labelled sample. Every path from a
root to a node is a conjunctive rule. A lasso logistic regression weights the rules and
leaves few of them; those are compiled into one Spark column expression over the
statistics of all documents.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, stage, table

#: Bound of the labelled sample that rules are fitted on.
SAMPLE_ROWS = 12_000
TREES, DEPTH, SHRINK, THRESHOLDS, LEAST_ROWS = 40, 3, 0.2, 24, 10
PENALTIES, STEPS = (0.02, 0.006, 0.002), 200
STATISTICS = ("words", "word_bytes", "upper", "digits", "symbols", "bangs", "pipes", "stops", "commas", "wide", "distinct", "top_word", "doubled",
              "short_words", "line_words", "distinct_lines")

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is above, threshold), all of which must hold


def statistics(text: str | None) -> tuple[float, ...]:
    """``STATISTICS`` of a whole text; all 0 where it has no word."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    size = len(raw)
    share = lambda letters: (size - len(raw.translate(None, letters))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    return (float(n), sum(map(len, words)) / n, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#$%&*@~^<>{}[]\\"),
            raw.count(b"!") / n, raw.count(b"|") / n, raw.count(b".") / n, raw.count(b",") / n, 1 - len(text) / size, len(counts) / n,
            max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, sum(c for w, c in counts.items() if len(w) < 4) / n,
            n / len(lines), len(set(lines)) / len(lines))


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, one double per statistic) of every whole text."""

    def run(batches):
        for b in batches:
            rows = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.record_batch([b.column(0), *(pa.array(c) for c in rows.T)], [id_col, *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """Conjunctive rules of all paths in boosted trees over halves of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, THRESHOLDS + 2)[1:-1])) for c in x.T]
    codes = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)]  # code <= j: value <= cut j
    z, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-z))
        residual, curve = y - prob, prob * (1 - prob)
        half = np.flatnonzero(rng.random(len(y)) < 0.5)
        usable = rng.permutation(x.shape[1])[:max(1, x.shape[1] * 2 // 3)]
        leaves = [((), half, np.arange(len(y)))]
        for _ in range(DEPTH):
            grown = []
            for path, own, whole in leaves:
                best = (1e-6, None)
                for f in usable:
                    n = len(cuts[f])
                    rows, sums = np.bincount(codes[f][own], minlength=n + 1), np.bincount(codes[f][own], residual[own], n + 1)
                    left, left_sum = np.cumsum(rows)[:n], np.cumsum(sums)[:n]
                    right = len(own) - left
                    fine = (left >= LEAST_ROWS) & (right >= LEAST_ROWS)
                    gain = np.where(fine, left_sum ** 2 / np.maximum(left, 1) + (sums.sum() - left_sum) ** 2 / np.maximum(right, 1), 0) - sums.sum() ** 2 / max(len(own), 1)
                    if n and gain.max() > best[0]:
                        best = (gain.max(), (int(f), int(gain.argmax())))
                if best[1] is None:
                    z[whole] += SHRINK * residual[own].sum() / (curve[own].sum() + 1.0)
                    continue
                f, j = best[1]
                for above in (False, True):
                    keep = lambda at: at[(codes[f][at] > j) == above]  # noqa: B023, E731
                    longer = (*path, (f, above, float(cuts[f][j])))
                    rules[tuple(sorted(longer))] = None
                    grown.append((longer, keep(own), keep(whole)))
            leaves = grown
        for _, own, whole in leaves:
            z[whole] += SHRINK * residual[own].sum() / (curve[own].sum() + 1.0)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > t) == above for f, above, t in rule])


def lasso(a: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal steps."""
    n, k = a.shape
    rate = 4 * n / (np.linalg.norm(a, ord="fro") ** 2 / min(k, 4) + n)
    w, b = np.zeros(k), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, ahead_b, t = w, b, 1.0
    loss = lambda v, c: np.logaddexp(0, (s := a @ v + c)).mean() - (y * s).mean()
    for _ in range(STEPS):
        off = 1 / (1 + np.exp(-(a @ ahead + ahead_b))) - y
        g, gb, base = a.T @ off / n, off.mean(), loss(ahead, ahead_b)
        while True:  # shorter steps until the quadratic bound holds
            v = ahead - rate * g
            new, new_b = np.sign(v) * np.maximum(np.abs(v) - rate * penalty, 0), ahead_b - rate * gb
            d, db = new - ahead, new_b - ahead_b
            if loss(new, new_b) <= base + g @ d + gb * db + (d @ d + db * db) / (2 * rate) + 1e-12:
                break
            rate /= 2
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """(bias, weighted rules); the penalty is the one with the least loss on every fifth row."""
    if not len(y) or y.min() == y.max():
        return (0.0 if not len(y) else float(np.log((y.mean() + 0.01) / (1.01 - y.mean())))), []
    rules = grow_rules(x, y)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    a = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    spread = np.maximum(a.std(axis=0), 1e-3)
    a /= spread
    test = np.arange(len(y)) % 5 == 0
    best = None
    for penalty in PENALTIES:
        b, w = lasso(a[~test], y[~test], penalty)
        s = a[test] @ w + b
        loss = float(np.logaddexp(0, s).mean() - (y[test] * s).mean())
        if best is None or loss < best[0]:
            best = (loss, penalty)
    b, w = lasso(a, y, best[1])
    return float(b), [(r, float(v / s)) for r, v, s in zip(rules, w, spread) if v]


def compiled(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble as one column over the statistics: the probability of label 1."""
    total = F.lit(bias)
    for rule, weight in rules:
        tests = [F.col(STATISTICS[f]) > t if above else F.col(STATISTICS[f]) <= t for f, above, t in rule]
        total = total + F.when(reduce(lambda p, q: p & q, tests), F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  mod: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Learns from labels (0 or 1; others and null are left out) of rows whose crc32(id as text) mod ``mod`` is not
    ``held``, about ``sample_rows`` of them by hash. Only the text is looked at. Null, empty and blank texts have
    all statistics 0 and are scored like others. Without labels every score is 0.5. Ties at a threshold count as below.
    Repeated rows get equal results, a null id is never held out nor labelled. An empty table gives no rows.
    """
    stats = stage(with_statistics(docs, id_col, text_col), "quality-statistics")
    learned = labels.where(remainder(id_col, mod) != held).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    n = learned.count()
    drawn = learned.withColumn("_u", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / float(1 << 40)).where(F.col("_u") <= sample_rows / max(n, 1))
    rows = drawn.join(stats, F.col("_id") == F.col(id_col)).select("_u", "_id", "_y", *STATISTICS).collect()
    rows.sort(key=lambda r: tuple(r))
    data = np.array([r[2:] for r in rows], dtype=np.float64).reshape(-1, 1 + len(STATISTICS))
    score = compiled(*fit(data[:, 1:], data[:, 0]))
    return stats.select(id_col, (remainder(id_col, mod) == held).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

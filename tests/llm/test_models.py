"""Language and quality: held-out accuracy, the chain against enumeration, rules against their columns."""

from itertools import product

import duckdb
import numpy as np
import pytest

from tidegrid.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    lengths, k = np.array([3, 1, 5]), 3
    e, t = rng.normal(size=(9, k)), rng.normal(size=(k, k))
    want, at = [], 0
    for n in lengths:
        total, z = np.zeros(k), 0.0
        for path in product(range(k), repeat=int(n)):
            w = np.exp(t[:, path[0]]).sum() * np.exp(sum(e[at + i, s] for i, s in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            z += w
            for s in path:
                total[s] += w
        want.append(total / z / n)
        at += n
    assert np.allclose(language.mean_marginals(e, lengths, t), want)


def test_marginals_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.array([200, 1, 33, 64])
    e, t = rng.normal(size=(lengths.sum(), 4)), rng.normal(size=(4, 4))
    a = language.mean_marginals(e, lengths, t)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.allclose(a, language.mean_marginals(e, lengths, t))


def test_code_switched_words():
    """Words of a text that changes its language midway are labelled on both sides."""
    docs = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet' WHERE lang IN ('en', 'de') ORDER BY doc_id").fetchall()
    samples = [(lang, language.words_of(t)[:160]) for lang, t in docs[:200]]
    model = language.fit(samples)
    fresh = {lang: [w for x, t in docs[300:] if x == lang for w in language.words_of(t)][:40] for lang in ("de", "en")}
    words = fresh["de"] + fresh["en"]
    a = np.exp(model.transitions)
    post, _ = language._expected(np.exp(model.emissions(words))[None], a)
    guess = [model.languages[i] for i in post[0].argmax(axis=1)]
    assert np.mean([g == ("de" if i < 40 else "en") for i, g in enumerate(guess)]) > 0.9
    assert a[0, 0] > a[0, 1] and a[1, 1] > a[1, 0]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.detect(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_awkward(awkward, no_rows):
    got = {r.doc_id: r for r in language.detect(awkward).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (5, 6, 7, 10))
    assert got[8].lang_pred == "en" and got[2].lang_pred == "de"
    assert language.detect(no_rows).collect() == []
    unknown = language.detect(awkward.where("lang is null")).collect()
    assert unknown and all(r.lang_pred == "und" for r in unknown)
    kept = language.in_known_language(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 8, 9, 11, 12, 13, None}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_rules_and_column_agree(spark):
    """The compiled column gives what the rules give in numpy; most rules have no weight."""
    rng = np.random.default_rng(4)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)
    bias, rules = quality.fit(x, y)
    total = bias + sum(w * quality.holds(r, x) for r, w in rules)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r[0] for r in df.select(quality.compiled(bias, rules)).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and ((np.array(got) > 0.5) == y).mean() > 0.95
    assert 0 < len(rules) < len(quality.grow_rules(x, y)) / 2


def test_lasso_is_optimal():
    """No weight can move without making the penalised loss larger."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(300, 8))
    y = (a[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    b, w = quality.lasso(a, y, 0.05)
    g = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
    assert np.all(np.abs(g) <= 0.05 + 1e-3) and np.allclose(g[w != 0], -0.05 * np.sign(w[w != 0]), atol=1e-3) and (w == 0).any()


def test_quality_awkward(spark, awkward, no_rows):
    labels = spark.createDataFrame([(0, 1), (8, 0), (2, None), (None, 1), (5, 7), (999, 1)], "doc_id long, quality int")
    got = quality.score_quality(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score_quality(no_rows, labels).collect() == []
    assert {r.score for r in quality.score_quality(awkward, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("text", [None, "", " \n", "a", "É\nÉ\n", "x" * 100_000])
def test_statistics_are_finite(text):
    got = quality.statistics(text)
    assert len(got) == len(quality.STATISTICS) and np.isfinite(got).all()

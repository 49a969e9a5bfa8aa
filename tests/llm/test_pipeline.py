"""The pipeline against brute force, stage by stage; skew helpers."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_dedup import components_brute, normal, simhash_brute
from test_mix_pack import check_bins, size, targets_brute

import corpus_pipeline
from tidegrid.llm.common import fresh, heavy_keys


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted exact and near copies, and some without letters."""
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300 AND length(text) < 9000")
    copies = docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.upper("text"))
    near = docs.where("doc_id BETWEEN 50 AND 80 AND length(text) > 4000").withColumn("doc_id", F.col("doc_id") + 2000).withColumn("text", F.concat("text", F.lit(" tail")))
    blank = spark.createDataFrame([(3000, "12 34 !!", None, "src1", 1), (3001, None, "en", None, None), (3002, "", "en", "src2", 0)], docs.schema)
    docs.unionByName(copies).unionByName(near).unionByName(blank).write.parquet(f"{path}/documents.parquet")
    return str(path)


def survivors(rows):
    """Documents with letters, the largest id of equal texts, the smallest id of each SimHash component."""
    rows = [r for r in rows if re.search(r"[^\W\d_]", r.text or "")]
    unique = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        unique[normal(r.text)] = r
    left = {r.doc_id: r for r in unique.values()}
    root = components_brute({i: simhash_brute(r.text) for i, r in left.items()})
    return {i: r for i, r in left.items() if root[i] == i}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = step(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs.count())
    want = survivors(spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert {tuple(r) for r in docs.collect()} == {tuple(r) for r in want.values()}
    assert seen[0] > seen[1] > seen[2] > seen[3]


def test_run(spark, folder):
    """Packed words are whole copies of the surviving documents, near the sources' targets, in valid bins."""
    want = survivors(spark.read.parquet(f"{folder}/documents.parquet").collect())
    words = check_bins(corpus_pipeline.run(spark, folder).collect(), 2048)
    sizes, taken = defaultdict(int), Counter()
    for i, r in want.items():
        sizes[r.source] += size(r.text)
        assert words[i] % size(r.text) == 0 and words[i] <= 3 * size(r.text)
        taken[r.source] += words[i]
    assert set(words) <= set(want)
    for s, target in targets_brute(dict(sizes)).items():
        assert abs(taken[s] - target) <= 0.02 * target + 10


def test_null_and_repeated_ids(spark, tmp_path):
    """No text is lost for want of an id of its own, or of a language to learn from; clashing column names pass through."""
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "eta") for b in "abcdefghij"]
    text = lambda i: " ".join(words[(i * 7 + j * (i + 3)) % 50] + str(i) for j in range(40))
    rows = [(None if i < 6 else 3, text(i), None, "s", i, "x") for i in range(12)] + [(9, "12 34", None, "s", 5, "x"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:4]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_id"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.text for r in docs.collect()} == {text(i) for i in range(12)}, name
    words = check_bins(corpus_pipeline.run(spark, str(tmp_path)).collect(), 2048)
    assert sum(words.values()) == 12 * 40


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "keep_id int, Copy int, x int")
    assert fresh(df, "keep_id", "copy", "own", "own") == ["keep_id_", "copy_", "own", "own_"]
    counts = spark.createDataFrame([("hot", 700), ("warm", 200), *[(f"k{i}", 1) for i in range(100)]], "k string, n long")
    assert {r.k for r in heavy_keys(counts, "k", "n", 10).collect()} == {"hot", "warm"}

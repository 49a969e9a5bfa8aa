"""Exact and SimHash deduplication against brute force."""

import hashlib
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm.common import stage_path
from tidegrid.llm.components import connected_components
from tidegrid.llm.exact_dedup import absorb, exact_duplicates, keep_unique
from tidegrid.llm.simhash import fingerprint, keep_one_of_each, near_duplicates, near_pairs

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(t):
    return (t or "").translate(str.maketrans(UP, LOW))


def exact_brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    out = []
    for r in rows:
        g = groups[normal(r.text)]
        keep = max((i for i in g if i is not None), default=None)
        out.append((r.doc_id, keep, len(g), r.doc_id == keep, hashlib.sha256(normal(r.text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(awkward, weak):
    """Also with a digest of one byte, where full texts must tell the groups apart."""
    how = {"digest": lambda b: F.unhex(F.substring(F.sha2(b, 256), 1, 2))} if weak else {}
    got = sorted((tuple(r) for r in exact_duplicates(awkward, **how).collect()), key=str)
    assert got == exact_brute(awkward.collect())


def test_exact_colliding_digests(awkward):
    got = sorted((tuple(r) for r in exact_duplicates(awkward, digest=lambda b: F.unhex(F.lit("00"))).collect()), key=str)
    assert got == exact_brute(awkward.collect())


def test_exact_keeps_one_row_and_columns(awkward, no_rows):
    kept = keep_unique(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    assert len(rows) == len({normal(r.text) for r in awkward.collect()}) == len({normal(r.text) for r in rows})
    assert exact_duplicates(no_rows).collect() == [] and keep_unique(no_rows).collect() == []


def test_exact_state_goes_on(spark):
    """A second run reads only the new file; its hits meet the state of the first."""
    feed, state, schema = stage_path(spark, "t-feed"), stage_path(spark, "t-state"), "id long, digest binary, locator string"
    a = spark.createDataFrame([(1, b"x", "f1"), (2, b"y", "f1")], schema)
    b = spark.createDataFrame([(9, b"x", "f2"), (0, b"z", "f2")], schema)
    a.write.mode("append").parquet(feed)
    absorb(spark, feed, a.schema, state)
    b.write.mode("append").parquet(feed)
    got = {bytes(r.digest): (r.keep_id, r.locator, r.group_size) for r in absorb(spark, feed, a.schema, state).collect()}
    assert got == {b"x": (9, "f2", 2), b"y": (2, "f1", 1), b"z": (0, "f2", 1)}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_state_meets_earlier_texts(spark, tmp_path, weak):
    """Rows of a second call are held against the texts of the first, read through their locators; a digest of one value must not join unlike texts."""
    how = {"digest": lambda b: F.unhex(F.lit("00"))} if weak else {}
    first, second = [(1, "Cat"), (2, "cat")], [(7, "CAT"), (5, "dog"), (6, "Dog"), (None, None)]
    for name, rows in (("a b", first), ("c", second)):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    calls = [sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark.read.parquet(f"{tmp_path}/{name}"), state=f"{tmp_path}/state", **how).collect()), key=str)
             for name in ("a b", "c")]
    assert calls[0] == [(1, 2, 2, False), (2, 2, 2, True)]
    assert calls[1] == sorted([(7, 7, 3, True), (5, 6, 2, False), (6, 6, 2, True), (None, None, 1, True)], key=str)


def simhash_brute(text):
    words = normal(text).replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_brute(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in fps}


def test_fingerprint(awkward):
    for r in awkward.collect():
        assert fingerprint(r.text) == simhash_brute(r.text)


def test_near_duplicates(awkward, no_rows):
    docs = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    fps = {r.doc_id: simhash_brute(r.text) for r in docs.collect()}
    want = {(i, f"{fps[i]:016x}", c) for i, c in components_brute(fps).items()}
    assert {tuple(r) for r in near_duplicates(docs).collect()} == want
    assert near_duplicates(awkward).count() == awkward.count()
    assert near_duplicates(no_rows).collect() == []
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_ids_that_are_null_or_repeat(spark):
    """Unlike texts without an id, or under one id, all stay."""
    docs = spark.createDataFrame([(i, f"{w} " * 30) for i, w in [(None, "apple"), (None, "river"), (None, "stone"), (7, "cloud"), (7, "table")]], "doc_id long, text string")
    assert sorted(map(str, keep_one_of_each(docs).collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("meeting", [2, 48])
def test_pairs_in_a_dense_ball(spark, rng, meeting):
    """A crowd of fingerprints around one point, next to random ones; keys get finer where too many meet."""
    centre = rng.getrandbits(64)
    crowd = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}
    crowd |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in crowd]
    got = {tuple(r) for r in near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), meeting=meeting).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(signed), 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_components(spark, rng):
    """A long chain, a star, loops, repeats and null ends."""
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (5, 4), (None, 3), (2000, 1999), (1999, 2000)]
    rng.shuffle(links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {1999: 1999, 2000: 1999}

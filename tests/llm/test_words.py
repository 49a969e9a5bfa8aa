"""Spelling variants, lexical search and piece encoding against brute force and the public library."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidegrid.llm import lexical, pieces, spelling

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- spelling variants

def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            seen[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    out, form_of = {}, {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form_of[w] = best
        out[w] = [n, len(near)]
    for w in words:
        root = w
        while root in form_of:
            root = form_of[root]
        form = form_of.get(w)
        yield w, form, root, *out[w], words.get(form)


def spelled(rng, n):
    """Documents with words of few letters, so that many are near each other and some are frequent."""
    common = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(30)]
    for i in range(n):
        yield i, " ".join(rng.choice(common) if rng.random() < 0.8 else "".join(rng.choice("abÉ") for _ in range(rng.randint(6, 9))) for _ in range(60))


@pytest.mark.parametrize("crowded", [4096, 6])
def test_variants_equal_brute_force(spark, rng, crowded):
    rows = [*spelled(rng, 60), *[(i, "Strasse Straßen strasser " * 12) for i in range(100, 130)], *[(i, "qwellen " * 60 + "qwellens " * (i % 10)) for i in range(200, 220)],
            *[(i, "qwelless") for i in range(300, 304)], (None, "lönely wörder lönely"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in spelling.spelling_variants(docs, crowded=crowded).collect()}
    want = set(variants(rows))
    assert got == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want), "chains of forms are meant to occur"


def test_each_pair_is_found_in_one_window(rng):
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 8))) for _ in range(200)})
    for cuts in ([0, 7], [0, 3, 7], [0, 1, 3, 5, 7], list(range(8))):
        seen = Counter()
        for lo, hi in zip(cuts, cuts[1:]):
            groups = {}
            for w in words:
                groups.setdefault(w[:lo] + "|" + w[len(w) - (7 - hi):], []).append(w)
            for block in groups.values():
                for w, near in zip(block, spelling.near_in_block(7, lo, hi, block)):
                    seen.update((w, x) for i, x in enumerate(block) if near >> i & 1)
        want = {(a, b) for a in words for b in words if one_apart(a, b) and min(len(a), len(b)) == 7}
        assert set(seen) == want and set(seen.values()) == {1}


def test_variants_of_awkward_rows(spark, awkward, no_rows):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert {tuple(r) for r in spelling.spelling_variants(awkward).collect()} == set(variants(rows))
    assert spelling.spelling_variants(no_rows).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(no_rows).count() == 0


def test_crowded_blocks_are_split(spark):
    words = spark.range(3000).selectExpr("concat('prefix', translate(lpad(conv(id, 10, 5), 6, '0'), '01234', 'vwxyz')) AS word", "id + 2 AS n")
    held = spelling.blocks(words, crowded=50).groupBy(*spelling.KEY).count()
    assert held.where("hi - lo > 1").agg({"count": "max"}).first()[0] <= 50


# ---- lexical search

def ranking(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, ts in asked.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // n_terms
            s = sum(w[t] * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            yield item, rank, i, -s


def lexical_rows(rng):
    words = ["the", "The", "cat", "sat", "öl", "Öl", "x2", "moon", "a"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)]
    docs += [(i, "the cat sat") for i in range(1000, 900, -1)] + [(5, "the cat"), (5, "the cat"), (None, "cat moon"), (None, None), (400, "")]
    items = [(1, "The CAT, the cat!"), (2, "moon öl"), (3, ""), (4, None), (5, "unseen"), (6, "a x2 sat"), (6, "moon")]
    return docs, items


@pytest.mark.parametrize("block_terms", [200_000, 3])
def test_search_equals_brute_force(spark, rng, block_terms):
    docs, items = lexical_rows(rng)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, bag string, n int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, lexical.ranked_search(d, i, block_terms=block_terms).collect()), key=str)
    assert got == sorted(ranking(docs, items), key=str)


def test_search_of_awkward_and_empty_tables(spark, awkward, no_rows):
    items = spark.createDataFrame([(1, "the katze word5 one"), (None, "two one")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted(map(tuple, lexical.ranked_search(awkward, items).collect()), key=str)
    assert got == sorted(ranking(rows, [tuple(r) for r in items.collect()]), key=str)
    assert lexical.ranked_search(no_rows, items).count() == 0
    assert lexical.ranked_search(awkward, items.limit(0)).count() == 0


def test_members_beyond_the_limit_do_not_travel(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'same text' AS text")
    items = spark.createDataFrame([(1, "same"), (2, "text other")], "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(9000 + i, f"nothing {i}") for i in range(9000)], "doc_id long, text string"))
    got = lexical.ranked_search(more, items, k=5).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in sorted(got)] == [(i, k + 1, k) for i in (1, 2) for k in range(5)]


# ---- piece encoding

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.read(MODEL)


BITS = ["a", "b", "e", "t", "h", "in", "er", " ", "  ", "▁", "é", "ß", "日本", "漢", "😀", "́", "\x00", "\n", "\t", "the", "tion", "<s>", "⁇", "ing", "1", "23", "==", "//", " " * 4,
        "aaaa", "\xad", "ﬁ", " " * 15, " " * 33]


def test_pieces_equal_the_library(library, vocabulary):
    rng = random.Random(2)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 40))) for _ in range(4000)]
    flat, counts = pieces.Encoder(vocabulary).encode(texts)
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == library.encode(texts)
    assert pieces.decode(flat, counts, vocabulary) == library.decode(got)


def test_any_ids_decode_as_in_the_library(library, vocabulary):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        pool = [rng.randrange(260), rng.randrange(32000), 259, 28705, 0, 1, 2, rng.randrange(130, 260)]
        rows.append(rng.choices(pool, k=rng.randint(0, 8)))
    flat = np.array([i for r in rows for i in r])
    assert pieces.decode(flat, np.array(list(map(len, rows))), vocabulary) == [library.decode(r) for r in rows]


@pytest.mark.parametrize("kind", ["random", "words", "same", "blanks", "other script"])
def test_long_words(library, vocabulary, kind):
    rng = random.Random(4)
    text = {"random": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)),
            "words": lambda: "".join(rng.choices(["the", "tion", "er", "house", "water", "ment", "Ly"], k=60_000)),
            "same": lambda: "a" * 200_000, "blanks": lambda: " " * 300_000 + "the" + " " * 31, "other script": lambda: "日本語漢字қ" * 30_000}[kind]()
    flat, counts = pieces.Encoder(vocabulary).encode(["x", text, ""])
    assert flat.tolist() == library.encode("x") + library.encode(text) and counts[2] == 0


def test_encoding_awkward_rows(spark, library, awkward, no_rows):
    rows = pieces.encode_pieces(awkward, MODEL)
    back = pieces.decode_pieces(rows, MODEL)
    want = sorted((str(r.doc_id), library.encode(r.text or ""), library.decode(library.encode(r.text or ""))) for r in awkward.collect())
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows.collect()) == want
    assert sorted((str(r.doc_id), r.decoded) for r in back.collect()) == [(a, c) for a, _, c in want]
    assert pieces.encode_pieces(no_rows, MODEL).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [5, None])], "doc_id long, ids array<int>")
    assert [r.decoded for r in pieces.decode_pieces(nulls, MODEL).sort("doc_id").collect()] == ["", "", library.decode([5])]

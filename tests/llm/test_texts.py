"""Token counts against the library, secrets against patterns, pages against their articles, vectors against brute force."""

import hashlib
import json
import random
import string
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import embeddings, html, secrets, tokens
from tidegrid.llm.registry import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a" * 5000, "aaaa aaa aa a", "ab" * 3000, "İstanbul ΣΑΣ ς ŉ", "don't we'll I'M he'd", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "é é ẛ̣",
       "12345 ½ ² ٣", "\x1c\x1d a\x1eb \x85 c d e　f​g", "日本語のテキスト 한국어 🙂🙃", "....!!!???", "_a_b_ --- \t\n\r\x0b\x0c", "﻿BOM \U0001f9d1‍\U0001f4bb"]


def test_tokens_match_the_library(spark, rng):
    alphabet = string.ascii_letters + string.digits + string.punctuation + "  \n\téßñÄŁжλ中'’"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    own = Tokenizer.from_file(PATH)
    want = [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(docs, PATH).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 2048) for i, t in enumerate(texts))


def test_long_words_merge_alike(rng):
    """Linked arrays, rounds over all symbols and the library agree; one word of 300,000 letters takes seconds."""
    vocabulary, own = tokens.Vocabulary.read(PATH), Tokenizer.from_file(PATH)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 500))).encode() for letters in ("ab", "aaab", "etaoin", "日本語") for _ in range(60)] + [b"a" * n for n in range(1, 90)]
    assert (tokens.merge_long_counts(words, vocabulary) == tokens.merge_counts(words, vocabulary)).all()
    word = "".join(rng.choice(string.ascii_lowercase) for _ in range(300_000))
    begin = time.perf_counter()
    got = tokens.Counter(vocabulary).count(word)
    assert time.perf_counter() - begin < 20
    assert got == len(own.encode(word, add_special_tokens=False).ids)


def test_tokens_awkward(awkward, no_rows):
    assert tokens.count_tokens(awkward, PATH).count() == awkward.count()
    assert tokens.count_tokens(no_rows, PATH).collect() == []


def base_brute(text):
    """The patterns one by one, as they are stated."""
    import re

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@pytest.mark.parametrize("text", ["", "password: hunter2x", "é token = 'abc'", "secret=token:abcdef1 API_KEY=\"" + "f" * 30 + '"', "AKIA" + "B" * 15 + " AKIA" + "C" * 16 + "AKIA", "0123456789abcdef01234567 apikey:==== ",
                                  "PASSWD : x.y-z_1 token=token=token=abc", "deadbeef" * 4])
def test_base_spans(text):
    assert secrets.base_spans(text) == base_brute(text)


def test_novel_strings(rng):
    """A random string after a sensitive word is reported, known identifiers are not."""
    names = ["connection_pool_manager", "request_handler_factory", "session_store_backend", "authentication_provider", "configuration_loader"]
    corpus = [" ".join(rng.choice(names) for _ in range(120)) for _ in range(200)]
    finder = secrets.Finder(secrets.train_dictionary(corpus))
    key = "".join(random.Random(9).choices(string.ascii_letters + string.digits, k=40))
    text = f"{corpus[0]} Authorization Bearer {key} then auth {names[0]}_{names[1]}"
    got = finder.spans(text)
    assert [text[s:e] for s, k, e in got if k == 3] == [key]
    twice = f"{corpus[1]} auth {key} {corpus[2]} auth {key}"
    assert [twice[s:e] for s, k, e in finder.spans(twice) if k == 3] == [key, key]


@pytest.mark.parametrize("before", ["auth via vault.example.com/prod: ", "token for connection_pool_manager, ", "password_reset_link_for_user=", "auth " + "f" * 24 + " "])
def test_keys_behind_other_candidates(before):
    names = ["connection_pool_manager", "password_reset_link_for_user", "vault.example.com/prod", "authentication_provider"]
    finder = secrets.Finder(secrets.train_dictionary([" ".join(random.Random(i).choices(names, k=120)) for i in range(200)]))
    for seed in range(20):
        key = "".join(random.Random(seed).choices(string.ascii_letters + string.digits, k=40))
        text = f"see {before}{key} and more"
        assert key in [text[s:e] for s, k, e in finder.spans(text) if k == 3]


def test_sensitive_words_without_end():
    """Two million characters of sensitive words take seconds; what is found are the keys between them, nine in ten being novel enough."""
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    text = "".join("the token of a day and more words " * 640 + f"auth {key()} " for _ in range(100))
    begin = time.perf_counter()
    found = secrets.Finder(b"").spans(text)
    assert time.perf_counter() - begin < 30
    assert len(text) > 2_000_000 and 80 < len(found) <= 100 and all(kind == 3 and end - start == 40 for start, kind, end in found)


def test_secrets_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_secret_scan"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_assign for r in rows)
    for r in rows:
        want = base_brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(secrets.listed(want).encode()).hexdigest()
        assert set(secrets.listed(want).split(",")) - {""} <= set(r.spans.split(","))


def test_identifiers_come_from_all_texts(spark):
    """A name from one document in twenty of 4,000, most behind long texts, is counted in full and is no secret; null, empty and blank texts count nothing."""
    name = "zq7Xv_91kPw3Rt_Yb5Hn2Lm8"
    filler = " ".join(f"plain{i}" for i in range(500))
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 20 == 3, F.concat(F.lit(filler + " "), F.lit(name))).when(F.col("id") % 20 == 4, "").when(F.col("id") % 20 == 5, " \t\n").when(F.col("id") % 20 != 6, F.concat(F.lit("text once"), F.col("id"))).alias("text"))
    counts = dict(secrets.identifier_counts(df, "text"))
    assert counts[name] == counts["plain7"] == 200 and counts["text"] == 3200 and "once8" not in counts
    dictionary = secrets.train_dictionary(secrets.training_text(secrets.identifier_counts(df, "text")))
    assert secrets.train_dictionary(secrets.training_text(secrets.identifier_counts(df.repartition(7), "text"))) == dictionary
    other = "".join(random.Random(3).choices(string.ascii_letters + string.digits, k=24))
    assert [k for _, k, _ in secrets.Finder(dictionary).spans(f"auth {name} and auth {other}")] == [3]


def test_secrets_awkward(awkward, no_rows):
    assert secrets.scan_secrets(awkward).count() == awkward.count()
    assert secrets.scan_secrets(no_rows).collect() == []


PAGE = ("<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav>"
        "<!-- no --><div class='ad'>Buy {n}</div><article><h1>Head {n}</h1><p><b>Bold{n}<br>next &lt;tag&gt; &eacute;<p>Second\n  part {n}</p>{more}<form><p>Sign up</p></form>"
        "<aside>See also</aside><div class=\"comments\"><p>First!</p></div></article><footer>&copy; me</footer></body></html>")


def test_pages_of_one_host(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.replace("{n}", str(i)).replace("{more}", "<p>More</p>" * (i % 4))) for i in range(12)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        want = " ".join([f"Head {i}", f"Bold{i} next <tag> é", f"Second part {i}", *["More"] * (i % 4)])
        assert got[i].text == want.replace(f"Bold{i} next", f"Bold{i} next") and got[i].n_chars == len(want) and got[i].url == rows[i][1]


def test_wrappers_come_from_all_pages(spark):
    """A lead that nine in ten pages of a host share is text, a notice that all of them have is not; nor is what a few pages share, or copies of one page, a notice."""
    page = "<html><body><article><h1>Head {n}</h1><p>{lead}</p><div>Notice of the host</div>{more}<p>Text {n}</p></article></body></html>"
    leads = {i: f"Own lead {i}" if i % 10 == 0 else "Shared lead" for i in range(40)}
    more = {i: "<blockquote>Quoted</blockquote>" if i % 8 == 1 else "" for i in range(40)}
    rows = [(100 * h + i, f"https://h{h}.example/{i}", page.format(n=i, lead=leads[i], more=more[i])) for h in range(10) for i in range(40)]
    rows += [(5000 + i, f"https://h0.example/c{i}", page.format(n=99, lead="Lead", more="<ul><li>Item</ul>")) for i in range(30)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, source in rows:
        i = k % 100
        assert got[k] == ("Head 99 Lead Item Text 99" if k >= 5000 else " ".join(x for x in (f"Head {i}", leads[i], "Quoted" if more[i] else "", f"Text {i}") if x))


def test_wrappers_of_many_layouts(spark, monkeypatch):
    """More layouts than a task merges: one wrapper a host, the same however the pages are dealt; a page that comes often counts once."""
    monkeypatch.setattr(html, "LAYOUTS", 2)
    body = lambda i: "".join(f"<{t}>{t}{i}</{t}>" for b, t in enumerate(["p", "div", "section", "pre"]) if i >> b & 1)
    rows = [(i, f"http://{'ab'[i % 3 > 0]}/{i}", f"<body><article><h1>t{i}</h1><h2>Same</h2>{body(i % 16)}</article></body>") for i in range(60)]
    rows += [(None, None, None), (61, "http://c/", ""), *[rows[0]] * 50]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, other = ({r.host: (r.wrapper, r.expression) for r in html.infer_wrappers(d).collect()} for d in (df.repartition(1), df.repartition(6, "page_id")))
    assert one == other and set(one) == {"a", "b"}
    pages = [html.tokens(r[2]) for r in rows[:60] if r[1].startswith("http://b/")]
    title = next(w for w in json.loads(one["b"][0]) if w[5])
    assert title[5] == ["Same"] and len(json.loads(one["b"][0])) >= max(map(len, pages))


def test_pages_without_article():
    """Constants of a host's pages go, slots of the fullest container stay."""
    page = "<html><body><div><p>Same on all pages</p></div><div class='body'><p>Text {n} a</p><h2>t{n}</h2><p>Text {n} b</p></div><div class='sidebar'>x {n}</div></body></html>"
    pages = [page.replace("{n}", str(i)) for i in range(5)]
    wrapper = html.infer([html.tokens(p) for p in pages])
    assert [html.extract(p, wrapper, html.main_slots(wrapper)) for p in pages] == [f"Text {i} a t{i} Text {i} b" for i in range(5)]


def test_constants_inside_articles():
    """A host's notice, its advert on some pages and its line among the paragraphs are no text; without the wrapper they are."""
    page = ("<html><body><article><h1>Head {n}</h1><div class='x'>Notice <b>of the host</b></div>{more}<p>Text {n} a<p>by and <i>by</i> {n}<p>Read on at our site</article></body></html>")
    pages = [page.replace("{more}", "<section>Buy now</section>" * (i % 2)).replace("{n}", str(i)) for i in range(8)]
    wrapper = html.infer([html.tokens(p) for p in pages])
    slots = html.main_slots(wrapper)
    want = [f"Head {i} Text {i} a by and by {i}" for i in range(8)]
    assert [html.extract(p, wrapper, slots) for p in pages] == want
    assert all("Notice of the host" in html.extract(p) and "Read on" in html.extract(p) for p in pages)
    same = [html.tokens(pages[0])] * 3
    assert html.extract(pages[0], html.infer(same), html.main_slots(html.infer(same))) == html.extract(pages[0])


def test_headings_of_all_pages_stay():
    """A heading that every page of a host has stays with the text under it and goes with a notice under it."""
    page = "<html><body><article><h1>Head {n}</h1><h2>Summary</h2><p>Short {n}<h2><i>Method</i></h2><div>Long {n}</div><h3>Notice</h3><p>Same on all pages<h2>Last</h2></article></body></html>"
    pages = [page.replace("{n}", str(i)) for i in range(8)]
    wrapper = html.infer([html.tokens(p) for p in pages])
    assert [html.extract(p, wrapper, html.main_slots(wrapper)) for p in pages] == [f"Head {i} Summary Short {i} Method Long {i}" for i in range(8)]


def test_deep_and_long_pages(rng):
    """20,000 nested tags, 20,000 paragraphs and pages without common order take seconds, with all their text."""
    begin = time.perf_counter()
    deep = ["<body>" + "".join(f"<div>{k}" for k in range(n)) + "</div>" * n + "<p>end" for n in (20_000, 12_000)]
    wrapper = html.infer([html.tokens(p) for p in deep])
    assert html.extract(deep[0]).split() == [*map(str, range(20_000)), "end"]
    assert html.extract(deep[1], wrapper, html.main_slots(wrapper)).split()[:12_000] == [*map(str, range(12_000))]
    assert html.extract("<p>a<!-- c -->" * 20_000) == " ".join("a" * 20_000)
    mixed = ["<article>" + "".join(rng.choice(["<p>a", "<div>b</div>", "<ul><li>c</ul>", "<h4>d</h4>", "<b>", "</b>", "<i>e</i>"]) for _ in range(5000)) for _ in range(4)]
    wrapper = html.infer([html.tokens(p) for p in mixed])
    plain = [html.extract(p) for p in mixed]
    assert all(len(t) > 5000 for t in plain) and len(wrapper) > 5000
    assert time.perf_counter() - begin < 60


def test_alignment_is_a_common_series(rng):
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 60))] for _ in range(2))
        pairs = list(html.aligned(a, b))
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in pairs if i is not None and j is not None)
    a, b = ["x", *"ab" * 1000, "y"], ["x", *"ba" * 900, "z"]
    assert sum(i is not None and j is not None for i, j in html.aligned(a, b)) > 1700


@pytest.mark.parametrize("page", ["<body class='has-sidebar'><article><p>Text</p></article><div class='sidebar'>x</div></body>", "<body class='no-sidebar menu-open'><div><p>Text</p></div></body>",
                                  "<div class='content-sidebar-wrap'><article><p>Text</p></article><div class='related'><article>x</article></div></div>",
                                  "<body><div class='content-sidebar-wrap'><div class='post'><p>Text</p></div><div class='sidebar'>x</div></div></body>",
                                  "<article><div class='share-price'>Text</div><div class='share'>x</div><div class='comments-area'>x</div></article>", "<article><div class='entry-header'>Text</div></article>"])
def test_names_of_layouts_are_no_boilerplate(page):
    assert html.extract(page) == "Text"


def test_texts_the_wrapper_lacks():
    """A table inside the main container that no sampled page had stays."""
    page = "<html><body><div><h2>Same on all pages</h2></div><section><p>Text {n} a</p><h2>t{n}</h2>{more}<p>Text {n} b</p></section><div class='sidebar'>x {n}</div></body></html>"
    wrapper = html.infer([html.tokens(page.replace("{more}", "").replace("{n}", str(i))) for i in range(5)])
    new = page.replace("{more}", "<table><tr><td>Row</td></tr></table>").replace("{n}", "9")
    assert html.extract(new, wrapper, html.main_slots(wrapper)) == "Text 9 a t9 Row Text 9 b"


def test_wrapper_has_groups():
    pages = [html.tokens(f"<ul>{'<li>x</li>' * n}</ul>{'<p>opt</p>' if n > 2 else ''}<h2>{n}</h2>") for n in (1, 2, 3)]
    text = html.expression(html.infer(pages))
    assert "( <li> # </li> )+" in text and "( <p> opt </p> )?" in text and text.endswith("<h2> # </h2>")


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "plain text", "<script>never ends", "<!-- open", "<p>" * 3000, "</div></p>", "<a href='x>y</a>", "<p>a<b>b</i>c" * 50, "&bogus; &#0; &#x110000;"])
def test_broken_pages(page):
    text = html.extract(page)
    assert isinstance(text, str) and text == " ".join(text.split())


def test_pages_awkward(spark):
    rows = [(1, None, None), (None, "no url", "<p>x</p>"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "HTTP://User@H:80/x", "<p>y</p>")]
    df = spark.createDataFrame([(*r, "w", "h", 1) for r in rows], "page_id long, url string, html string, wrapper string, host string, id long")
    assert sorted(r.text for r in html.main_text(df).collect()) == ["", "", "", "x", "y"]
    assert html.main_text(df.limit(0)).collect() == []


def links_brute(unit, threshold=0.95):
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(unit))
    while (low := np.minimum(root, np.where(near, root[None, :], len(unit)).min(axis=1))).tolist() != root.tolist():
        root = low
    return near.sum(axis=1), root


@pytest.mark.parametrize("block", [16, 1024])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    """A third of the vectors around one point, small groups, singles; long lists dealt in blocks."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(140, 24))
    x = np.concatenate([centres[0] + 0.12 * rng.normal(size=(120, 24)), *[c + 0.15 * rng.normal(size=(3, 24)) for c in centres[1:40]], centres[40:]])
    docs = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_vectors(docs).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, root = links_brute(unit)
    found, true = sum(r.n_links for r in got.values()), links.sum()
    assert all(got[i].n_links <= links[i] and got[i].kept == (got[i].component_id == i) for i in got) and found >= 0.98 * true
    assert np.mean([got[i].component_id == root[i] for i in got]) > 0.98


@pytest.mark.parametrize("together", [2, 40, 16384])
def test_copies_of_vectors_are_searched_once(spark, monkeypatch, together):
    """Copies count as links of their own; results don't depend on how lists are taken together."""
    monkeypatch.setattr(embeddings, "TOGETHER", together)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([np.repeat(centres[:1], 900, axis=0), centres[0] + 0.05 * rng.normal(size=(20, 16)), *[np.repeat(c[None], 3, axis=0) for c in centres[1:30]], centres[30:]])
    docs = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_vectors(docs).collect()}
    links, root = links_brute(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert [got[i].n_links for i in range(len(x))] == list(links)
    assert [got[i].component_id for i in range(len(x))] == list(root)


@pytest.mark.parametrize("wanted", [88, 400, 1000, 2048, 4096])
@pytest.mark.parametrize("cosine", [0.95, 0.96])
def test_pairs_at_the_threshold_meet(wanted, cosine):
    """However many pivots a large table has, planted pairs share enough of them."""
    rng = np.random.default_rng(1)
    rows = lambda n: (x := rng.normal(size=(n, 16))) / np.linalg.norm(x, axis=1, keepdims=True)
    pivots = rows(1)
    while len(pivots) < wanted:
        v = rows(1)
        if (pivots @ v[0]).max() < embeddings.APART:
            pivots = np.vstack([pivots, v])
    a, other = rows(2000), rows(2000)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine ** 2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    x, y = (embeddings.permutation_prefixes(v, pivots) for v in (a, b))
    assert ((x[:, :, None] == y[:, None, :]).any(axis=2).sum(axis=1) >= embeddings.SHARED).mean() >= 0.96


def test_vectors_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    links, _ = links_brute(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = {r.vec_id: r.n_links for r in QUERIES["op8_embedding_near_dedup"](spark, sf).collect()}
    assert sum(got.values()) >= 0.9 * links.sum() and len(got) == len(rows)


def test_vectors_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1e-300, 2e-300]), (11, [1e300, 2e300]), (12, [2.0, -1.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, row string, label int, n_links int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect())
    linked = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (10, 4, 1, False), (11, 4, 1, False)]
    assert got == sorted(linked + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12)])
    assert embeddings.near_vectors(df.limit(0)).collect() == []

"""Mixing against its definition, packing against its constraints and a plain search."""

import re
from collections import Counter, defaultdict

import pytest

from tidegrid.llm.mixing import mix, mixed_documents
from tidegrid.llm.packing import best_fit, pack


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets_brute(sizes):
    """Share by weight, cap at three times the size, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        free -= over


def check_mix(rows, got, slack):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want = targets_brute(dict(sizes))
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for g in got:
        s = source[g.doc_id]
        assert g.source_size == sizes[s] and g.target == pytest.approx(want[s]) and g.taken == g.size * g.copies and 0 <= g.copies <= 3
        taken[s] += g.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= slack(s), (s, taken[s], want[s])


def test_mix_capped_sources(spark, rng):
    """One source with a third of all rows, small ones that hit the cap, a null and an empty one."""
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 7}") for i in range(3000)]
    rows += [(10_000 + i, "tiny text", "Zsmall") for i in range(5)] + [(20_000, "", "blank"), (20_001, None, "blank")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    check_mix(docs.collect(), got, lambda s: 2)
    assert sorted(map(str, mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    copies = {g.doc_id: g.copies for g in got}
    assert Counter(r.doc_id for r in mixed_documents(docs).collect()) == Counter({i: c for i, c in copies.items() if c})


@pytest.mark.parametrize("seed", ["", "a", "b"])
def test_mix_with_one_document_above_the_target(spark, seed):
    """One document of 900 words in a thousand of ten: the target is met within a small one, whichever comes first by rank."""
    rows = [(i, " ".join(["w"] * 10), "a") for i in range(1000)] + [(5000, " ".join(["w"] * 9000), "a")] + [(7000 + i, " ".join(["w"] * 7), "b") for i in range(900)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2), seed=seed).collect()
    for source, some in (("a", [r for r in got if r.doc_id < 7000]), ("b", [r for r in got if r.doc_id >= 7000])):
        assert all(0 <= r.copies <= 3 for r in some)
        target, taken = some[0].target, sum(r.taken for r in some)
        reach = 3 * sum(r.size for r in some if r.size <= target)
        assert abs(taken - min(target, reach)) <= 10, source


def test_mixed_documents_lose_no_text(spark):
    """Null ids and one id for several texts: every text that the mix draws comes out."""
    rows = [(None, f"text {i} " + "w " * i, "s") for i in range(5)] + [(1, "one text", "s"), (1, "another text", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = Counter((r.doc_id, r.text) for r in mixed_documents(docs).collect())
    assert set(out) == {(i, t) for i, t, _ in rows}, "one source takes all its words"
    assert set(out.values()) == {1}


def test_mix_preference(spark):
    """Within a source, preferred documents are drawn more often; whole copies come first."""
    docs = spark.createDataFrame([(i, "a b c d", "x" if i < 600 else "y", 4.0 if i % 2 else 1.0) for i in range(1200)], "doc_id long, text string, source string, liked double")
    got = mix(docs, preference="liked", weights=(1, 2)).collect()
    for s in (range(600), range(600, 1200)):
        own = [g for g in got if g.doc_id in s]
        liked, other = (sum(g.copies for g in own if g.doc_id % 2 == k) for k in (1, 0))
        assert liked > 2 * other
        assert abs(sum(g.taken for g in own) - own[0].target) <= 4


def test_mix_awkward(awkward, no_rows):
    rows = awkward.collect()
    got = mix(awkward).collect()
    assert len(got) == len(rows) and all(g.taken == 0 for g in got if g.size == 0)
    assert mix(no_rows).collect() == []
    assert mixed_documents(awkward).columns == awkward.columns


def best_fit_brute(items, capacity):
    """Every bin looked at for every item: the tightest that is compatible, the oldest of equal ones."""
    bins = []
    for key, n, source, cluster in sorted(items, key=lambda i: -(i[1] % capacity)):
        n %= capacity
        fits = [b for b in bins if b[0] >= n and source not in b[1] and cluster not in b[2]] if n else None
        if fits is None:
            continue
        b = min(fits, key=lambda b: b[0], default=None)
        if b is None:
            bins.append(b := [capacity, set(), set(), []])
        b[0] -= n
        b[1].add(source)
        b[2].add(cluster)
        b[3].append(key)
    return sorted(tuple(b[3]) for b in bins)


def test_best_fit_is_the_tightest(rng):
    items = [(i, rng.randint(0, 250), rng.choice("aaabcdefgh"), rng.choice([rng.randint(0, 9), 100 + i])) for i in range(400)]
    placed = best_fit(items, 100)
    bins = defaultdict(list)
    for key, _, words, _, bin_no, _ in placed:
        if bin_no is not None and words < 100:
            bins[bin_no].append(key)
    assert sorted(tuple(b) for b in bins.values()) == best_fit_brute(items, 100)


def check_bins(rows, capacity):
    bins, words = defaultdict(list), Counter()
    for r in rows:
        words[r.doc_id] += r.n_words
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.bin_start)
        assert sum(r.n_words for r in b) <= capacity
        assert [r.bin_start for r in b] == [sum(r.n_words for r in b[:i]) for i in range(len(b))]
        assert len({r.source for r in b}) == len(b) == len({r.cluster for r in b})
    return words


def test_pack_awkward(awkward, no_rows):
    rows = pack(awkward, capacity=64).collect()
    want = Counter()
    for r in awkward.collect():
        want[r.doc_id] += size(r.text)
    assert check_bins(rows, 64) == want
    assert {r.doc_id for r in rows if r.bin_id is None} >= {5, 6, 7}
    assert pack(no_rows).collect() == []


def test_pack_shards_and_hot_keys(spark, rng):
    """A source with a third of the rows, a cluster with a third, one id repeated; several shards."""
    rows = [(7 if i % 4 == 0 else i, " ".join([str(i)] * rng.randint(1, 30)) if i % 3 else "the same few words", "hot" if i % 3 == 1 else f"s{i % 11}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pack(docs, capacity=50, shard_rows=100).collect()
    want = Counter()
    for i, t, _ in rows:
        want[i] += size(t)
    assert check_bins(got, 50) == want
    assert len({r.bin_id >> 32 for r in got}) == 9

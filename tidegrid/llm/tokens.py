"""Token counts of whole texts for a word-level byte-pair vocabulary with word ends.

Distinct pre-tokens of a batch are held as one ragged array of symbol numbers. In each round
every sequence finds its pair of lowest rank and all its occurrences are merged, in all
sequences at the same time; a sequence without a mergeable pair is done and its
surviving symbols are counted. Long sequences share linked arrays in which the places of each
rank are kept apart, so a round costs what it merges, not what is left.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 2048
#: Chunks of texts whose counts a worker remembers, and characters merged at once.
REMEMBERED, AT_ONCE = 400_000, 2_000_000
#: Bytes of a pre-token from which it is merged in linked arrays; the result is the same.
LONG = 256
#: Python splits at these too, the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


@dataclass
class Vocabulary:
    """Symbols of bytes inside and at the end of a word, merges ordered by pair, special strings, pattern of pre-tokens."""

    inner: np.ndarray
    final: np.ndarray
    size: int
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    specials: list[str]
    pattern: str

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in ``pairs``; -1 where nothing merges."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(0x100, 0x200))
        letter = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
        size = len(ids)
        rows = sorted((ids[a] * size + ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"]))
        pairs, ranks, merged = (np.array(c, dtype=np.int64) for c in zip(*rows))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        symbol = lambda s: np.array([ids[c + s] for c in letter], dtype=np.int64)
        return cls(symbol(""), symbol(end), size, pairs, ranks, merged, [t["content"] for t in spec["added_tokens"]], split)


def symbols(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words (one byte or more) that lie end to end, and each one's word."""
    lengths = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    sym, ends = v.inner[data], np.cumsum(lengths) - 1
    sym[ends] = v.final[data[ends]]
    return sym, np.repeat(np.arange(len(words)), lengths)


def alternate(follows: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences in a run every second one, from the left; ``follows``: begins inside the one before it."""
    place = np.arange(len(follows))
    return (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0


def merge_counts(words: list[bytes], v: Vocabulary) -> np.ndarray:
    """Surviving symbols of each word (one byte or more) after all merges."""
    sym, seq = symbols(words, v)
    counts = np.bincount(seq, minlength=len(words))
    none = len(v.pairs)
    while len(sym) > 1:
        at = v.look_up(sym[:-1], sym[1:])
        rank = np.append(np.where((at >= 0) & (seq[:-1] == seq[1:]), v.ranks[at], none), none)
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        low = np.minimum.reduceat(rank, first)
        low_of = np.repeat(low, np.diff(np.append(first, len(seq))))
        hit = np.flatnonzero((rank == low_of) & (low_of < none))
        if not len(hit):
            break
        left = hit[alternate(np.append(False, np.diff(hit) == 1))]
        sym[left] = v.merged[at[left]]
        counts -= np.bincount(seq[left], minlength=len(counts))
        keep = low_of < none  # sequences without a pair are done
        keep[left + 1] = False
        sym, seq = sym[keep], seq[keep]
    return counts


def merge_long_counts(words: list[bytes], v: Vocabulary) -> np.ndarray:
    """The same for long words: the lowest rank of all is merged wherever it occurs, so there are no more rounds than ranks.

    A word meets its own ranks in the order in which it would meet them alone.
    """
    sym, seq = symbols(words, v)
    n, none = len(sym), len(v.pairs)
    counts = np.bincount(seq, minlength=len(words))
    inner = np.append(seq[:-1] == seq[1:], False)
    nxt = np.where(inner, np.arange(1, n + 1), n)  # n: beyond the word's end
    prv = np.append(np.where(inner, np.arange(n), -1), -1)[np.arange(-1, n)]  # -1: before its begin
    rank, into = np.full(n, none), np.zeros(none, dtype=np.int64)
    into[v.ranks] = v.merged
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def put(places: np.ndarray) -> None:
        """Look at the pairs that begin at ``places`` and keep them by rank."""
        rank[places] = none
        places = places[nxt[places] < n]
        at = v.look_up(sym[places], sym[nxt[places]])
        places, found = places[at >= 0], v.ranks[at[at >= 0]]
        if not len(places):
            return
        rank[places] = found
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        bounds = [0, *cuts.tolist(), len(found)]
        for r, lo, hi in zip(found[bounds[:-1]].tolist(), bounds, bounds[1:]):
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(places[lo:hi])

    put(np.arange(n))
    while ranks:
        low = heapq.heappop(ranks)
        parts = waiting.pop(low)
        left = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        left = left[rank[left] == low]
        if not len(left):
            continue
        left = left[alternate(np.append(False, nxt[left[:-1]] == left[1:]))]
        right = nxt[left]
        after = nxt[right]
        sym[left], rank[right], nxt[left] = into[low], none, after
        prv[after] = left  # the last entry takes what has nothing after it
        counts -= np.bincount(seq[left], minlength=len(counts)) if len(words) > 1 else len(left)
        before = prv[left]
        put(np.union1d(left, before[before >= 0]))
    return counts


class Counter:
    """Counts tokens of texts; remembers counts of the chunks between white space."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {"": 0}
        self.split = regex.compile(v.pattern)
        self.special = re.compile("|".join(map(re.escape, v.specials))) if v.specials else None

    def chunks(self, text: str) -> list[str]:
        return SPACE.split(text) if SEPARATORS.search(text) else text.split()

    def _words(self, chunk: str) -> list[bytes]:
        # Lower case letter by letter, as the tokenizer does: a final sigma is like any other.
        low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if low.isalpha():  # letters only are one pre-token; the pattern would say the same
            return [low.encode()]
        if low[-1:] in {",", "."} and low[:-1].isalpha():
            return [low[:-1].encode(), low[-1:].encode()]
        return [w.encode() for w in self.split.findall(low)]

    def learn(self, chunks: set[str]) -> None:
        """Count chunks not yet known, all their pre-tokens together."""
        fresh = [c for c in chunks if c not in self.known]
        for at in range(0, len(fresh), 20_000):
            self._learn(fresh[at:at + 20_000])

    def _learn(self, fresh: list[str]) -> None:
        special, words = {}, {}
        for c in fresh:
            if self.special and "<" in c:
                special[c] = len(self.special.findall(c))
                words[c] = [w for part in self.special.split(c) for w in self._words(part)]
            else:
                words[c] = self._words(c)
        distinct = list({w: None for ws in words.values() for w in ws})
        counts: dict[bytes, int] = {}
        batch, size = [], 0
        for merge, own in ((merge_counts, [w for w in distinct if len(w) <= LONG]), (merge_long_counts, [w for w in distinct if len(w) > LONG])):
            for w in [*own, None]:
                if batch and (w is None or size + len(w) > AT_ONCE):
                    counts.update(zip(batch, merge(batch, self.v).tolist()))
                    batch, size = [], 0
                if w is not None:
                    batch.append(w)
                    size += len(w)
        for c in fresh:
            self.known[c] = special.get(c, 0) + sum(map(counts.__getitem__, words[c]))

    def count(self, text: str | None) -> int:
        chunks = self.chunks(text or "")
        if len(self.known) > REMEMBERED:
            self.known = {"": 0}
        self.learn(set(chunks))
        return sum(map(self.known.__getitem__, chunks))

    def count_all(self, texts: list[str | None]):
        """Counts of a batch: what is not known in any of its texts is merged together."""
        for at in range(0, len(texts), 256):
            part = [self.chunks(t or "") for t in texts[at:at + 256]]
            if len(self.known) > REMEMBERED:
                self.known = {"": 0}
            self.learn(set().union(*part))
            yield from (sum(map(self.known.__getitem__, c)) for c in part)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``path`` is a vocabulary file in the tokenizers library's format with byte-level pairs and a word-end suffix.
    Special strings in a text count one token each; none is added. Null counts as empty: 0 bytes, 0
    tokens. Repeated rows are counted each; other columns are not read. An empty table gives no rows.
    The vocabulary, of fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches):
        counter = Counter(shared.value)
        for b in batches:
            n = list(counter.count_all(b.column(1).to_pylist()))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                  [id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

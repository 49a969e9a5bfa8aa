"""Language of documents by a linear-chain conditional random field over their words.

Words have affix, n-gram and lexicon features; transitions between the languages of
neighbouring words are learned from code-switched sequences spliced from documents of
known language. Forward-backward gives each word a probability per language; a document's
score for a language is the mean over its words.

The field is fitted on the driver on a bounded sample; every whole text is then labelled
in tasks, in batches of words laid out in blocks, so that a long text costs no more per word.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, stage, table

#: Bounds of the sample that the field is fitted on: documents per language, and words in a row from each.
SAMPLE_DOCS, SAMPLE_WORDS = 300, 160
LEXICON = 200
HASHED = 1 << 15
SEQUENCE, EPOCHS, RATE, DECAY = 64, 40, 0.15, 1e-4
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Words of a batch that are labelled at once, words in a block, and words whose scores a worker remembers.
BATCH_WORDS, BLOCK, REMEMBERED = 50_000, 32, 80_000
#: Rows that are labelled and sent on together where whole rows pass through.
PASSED = 1000


def words_of(text: str | None) -> list[str]:
    """Lower-case letter runs of a text; none where it has no letter."""
    words = LETTERS.findall((text or "").lower())
    return words if any(w.isalpha() for w in words) else []


def _hash(kind: int, *columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), kind, dtype=np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(HASHED)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(features, owners): hashed features of all words and the position of the word each belongs to.

    A word's features are itself, its letter pairs and triples with its ends marked, its affixes of two to four
    letters, and the language whose lexicon has it.
    """
    code = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words])
    first = np.cumsum(length + 2) - length - 1  # first letter of each word
    owner, every = np.repeat(np.arange(len(words)), length + 2), np.arange(len(words))
    power = np.cumprod(np.full(int(length.max()) + 2, 0x100000001B3, dtype=np.uint64))
    place = np.arange(len(code)) - np.repeat(first - 1, length + 2)
    found = [(_hash(1, np.add.reduceat(code * power[place], first - 1)), every)]
    for n in (2, 3):
        at = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:])
        found.append((_hash(n, *(code[at + j] for j in range(n))), owner[at]))
    for n in (2, 3, 4):
        long = np.flatnonzero(length >= n)
        for kind, start in ((10, first[long]), (20, first[long] + length[long] - n)):
            found.append((_hash(kind + n, *(code[start + j] for j in range(n))), long))
    known = np.array([lexicon.get(w, -1) for w in words])
    found.append((_hash(30, known[known >= 0].astype(np.uint64)), np.flatnonzero(known >= 0)))
    return np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found])


@dataclass
class Field:
    """Languages, lexicon (word to language number), feature weights, transition scores."""

    languages: list[str]
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    transitions: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words, L) of words without their neighbours."""
        flat, owner = features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[flat, j], len(words)) for j in range(len(self.languages))], axis=1)


def _expected(e: np.ndarray, a: np.ndarray):
    """Marginals (n, t, L) and summed pair marginals (L, L) of equally long sequences. ``e``, ``a``: exponentiated."""
    n, steps, k = e.shape
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    now = np.full((n, k), 1.0 / k)
    for t in range(steps):
        now = (now @ a) * e[:, t]
        now /= now.sum(axis=1, keepdims=True)
        fwd[:, t] = now
    now = np.ones((n, k))
    for t in range(steps - 1, -1, -1):
        bwd[:, t] = now
        now = (e[:, t] * now) @ a.T
        now /= now.sum(axis=1, keepdims=True)
    post = fwd * bwd
    post /= post.sum(axis=2, keepdims=True)
    left, right = fwd[:, :-1].reshape(-1, k), (e[:, 1:] * bwd[:, 1:]).reshape(-1, k)
    norm = ((left @ a) * right).sum(axis=1, keepdims=True)
    return post, a * (left.T @ (right / norm))


def fit(samples: list[tuple[str, list[str]]], seed: int = 7) -> Field:
    """Fit a field on (language, words in a row) samples by gradient ascent on the likelihood of spliced sequences."""
    languages = sorted({lang for lang, words in samples if words})
    model = Field(languages)
    if not languages:
        return model
    k, number = len(languages), {x: i for i, x in enumerate(languages)}
    counts = [Counter() for _ in languages]
    for lang, words in samples:
        if words:
            counts[number[lang]].update(words)
    for i, c in enumerate(counts):
        for word, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if all(n > 4 * other[word] for j, other in enumerate(counts) if j != i):
                model.lexicon[word] = i
    rng = np.random.default_rng(seed)
    parts = [(number[lang], words[at:at + step]) for lang, words in samples for step in [int(rng.integers(12, SEQUENCE + 1))] for at in range(0, len(words), step)]
    stream = [(w, i) for p in rng.permutation(len(parts)) for i, ws in [parts[p]] for w in ws]
    stream = stream * (1 + SEQUENCE // len(stream))
    n = len(stream) // SEQUENCE
    stream = stream[:n * SEQUENCE]
    vocabulary = {w: j for j, w in enumerate(dict.fromkeys(w for w, _ in stream))}
    ids = np.array([vocabulary[w] for w, _ in stream]).reshape(n, SEQUENCE)
    gold = np.eye(k)[np.array([i for _, i in stream])].reshape(n, SEQUENCE, k)
    flat, owner = features(list(vocabulary), model.lexicon)
    w, tr = np.zeros((HASHED, k)), np.eye(k)
    w2, tr2 = np.full_like(w, 1e-8), np.full_like(tr, 1e-8)
    gold_pairs = gold[:, :-1].reshape(-1, k).T @ gold[:, 1:].reshape(-1, k)
    for _ in range(EPOCHS):
        e = np.stack([np.bincount(owner, w[flat, j], len(vocabulary)) for j in range(k)], axis=1)[ids]
        post, pairs = _expected(np.exp(e - e.max(axis=2, keepdims=True)), np.exp(tr))
        off = (gold - post).reshape(-1, k)
        by_word = np.stack([np.bincount(ids.ravel(), off[:, j], len(vocabulary)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(flat, by_word[owner, j], HASHED) for j in range(k)], axis=1) / n - DECAY * w
        gt = (gold_pairs - pairs) / n - DECAY * tr
        w2 += g * g
        tr2 += gt * gt
        w += RATE * g / np.sqrt(w2)
        tr += RATE * gt / np.sqrt(tr2)
    model.weights, model.transitions = w, tr
    return model


def mean_marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Mean over each document's words of forward-backward marginals, (documents, L).

    ``emissions``: scores of all words, document after document; ``lengths``: words in each, 1 or more.
    Documents are laid out in blocks. The product of a block's steps carries the forward and
    backward vectors over it, so only the blocks of a document are taken one after another.
    """
    k, a = emissions.shape[1], np.exp(transitions - transitions.max())
    blocks = -(-lengths // BLOCK)
    offset = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    nb = int(blocks.sum())
    word_at = np.arange(len(emissions)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    slot = np.repeat(offset, lengths) * BLOCK + word_at
    e = np.ones((nb * BLOCK, k))
    e[slot] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    real = np.zeros(nb * BLOCK, dtype=bool)
    real[slot] = True
    e, real = e.reshape(nb, BLOCK, k), real.reshape(nb, BLOCK)
    whole = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(BLOCK):
        step = (whole @ a) * e[:, t, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        whole = np.where(real[:, t, None, None], step, whole)
    by_length = np.argsort(-blocks, kind="stable")
    into, out = np.empty((nb, k)), np.empty((nb, k))
    sizes = blocks[by_length]
    now = np.full((len(lengths), k), 1.0 / k)
    for b in range(int(sizes[0])):
        live = by_length[:np.searchsorted(-sizes, -b, side="left")]
        at = offset[live] + b
        into[at] = now[live]
        step = np.einsum("ni,nij->nj", now[live], whole[at])
        now[live] = step / step.sum(axis=1, keepdims=True)
    now = np.ones((len(lengths), k))
    for b in range(int(sizes[0]) - 1, -1, -1):
        live = by_length[:np.searchsorted(-sizes, -b, side="left")]
        at = offset[live] + b
        out[at] = now[live]
        step = np.einsum("nij,nj->ni", whole[at], now[live])
        now[live] = step / step.sum(axis=1, keepdims=True)
    fwd = np.empty((nb, BLOCK, k))
    now = into
    for t in range(BLOCK):
        step = (now @ a) * e[:, t]
        now = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), now)
        fwd[:, t] = now
    total, now = np.zeros((nb, k)), out
    for t in range(BLOCK - 1, -1, -1):
        post = fwd[:, t] * now
        total += np.where(real[:, t, None], post / post.sum(axis=1, keepdims=True), 0.0)
        step = (e[:, t] * now) @ a.T
        now = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), now)
    return np.add.reduceat(total, offset, axis=0) / lengths[:, None]


class Labeller:
    """Labels batches of texts; remembers the scores of words it has seen, up to a bound."""

    def __init__(self, model: Field):
        self.model, self.index, self.scores = model, {}, np.empty((0, len(model.languages)))

    def _ids(self, words: list[list[str]]) -> list[np.ndarray]:
        fresh = sorted(set().union(*words).difference(self.index))
        if fresh:
            self.index.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
            self.scores = np.concatenate([self.scores, self.model.emissions(fresh)])
        return [np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws)) for ws in words]

    def label(self, texts) -> list[tuple[str, float]]:
        """(language, score) of each text; ``und`` and 0 without letters or without a learned language."""
        result: list[tuple[str, float]] = []
        waiting: list[tuple[int, list[str]]] = []
        words_waiting = 0
        for text in texts:
            words = words_of(text) if self.model.languages else []
            if words:
                waiting.append((len(result), words))
                words_waiting += len(words)
            result.append((UNKNOWN, 0.0))
            if words_waiting >= BATCH_WORDS:
                self._flush(waiting, result)
                waiting, words_waiting = [], 0
        self._flush(waiting, result)
        return result

    def _flush(self, waiting, result) -> None:
        if waiting:
            lengths = np.array([len(ws) for _, ws in waiting])
            ids = np.concatenate(self._ids([ws for _, ws in waiting]))
            emissions = self.scores[ids]
            mean = mean_marginals(emissions, lengths, self.model.transitions)
            for (at, _), best, row in zip(waiting, mean.argmax(axis=1), mean):
                result[at] = (self.model.languages[best], float(min(1.0, row[best])))
        if len(self.scores) > REMEMBERED:
            self.index, self.scores = {}, self.scores[:0]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_DOCS,
                    words: int = SAMPLE_WORDS) -> list[tuple[str, list[str]]]:
    """(language, words in a row) of at most ``per_language`` documents of each language, the first by hash of id and text.

    Rows that repeat both count once, so no more than about twice the bound reach the driver, whatever ids repeat or are null.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    # Written first, so that its size is known: a few rows are broadcast and no text is shuffled for the draw.
    counts = stage(known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")), "language-counts")
    drawn = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"),
                         (F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) / float(1 << 40)).alias("u"))
    near = drawn.join(counts, "lang").where(F.col("u") < 2.0 * per_language / F.col("n"))

    def run(batches):
        for b in batches:
            rows = []
            for lang, text, u, i in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "u", "id"))):
                got = words_of(text)
                at = int(u * 1e9) % max(1, len(got) - words + 1)
                rows.append((lang, got[at:at + words], u, str(i)))
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.list_(pa.string()), pa.float64(), pa.string()))], ["lang", "words", "u", "id"])

    rows = near.select("lang", "text", "u", F.col("id").cast("string").alias("id")).mapInArrow(run, "lang string, words array<string>, u double, id string")
    rows = rows.groupBy("lang", "u").agg(F.min("id").alias("id"), F.min("words").alias("words")).collect()
    result, taken = [], Counter()
    for r in sorted(rows, key=lambda r: (r.lang, r.u, r.id or "", r.words)):
        if taken[r.lang] < per_language:
            taken[r.lang] += 1
            result.append((r.lang, list(r.words)))
    return result


def label_documents(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score. Whole texts; null or letterless texts are ``und`` with score 0."""

    def run(batches):
        labeller = Labeller(model)
        for b in batches:
            got = labeller.label(t.as_py() for t in b.column(1))
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Learns from rows with a language whose crc32(id as text) mod ``held_out`` is not 0, and labels all rows by
    text alone. Languages of the sample are tied to words only; equal scores go to the first language in order. Null texts, empty
    texts and texts without a letter are ``und`` with score 0, and so is all where nothing can be learned. Repeated
    rows get equal results; a null id is never held out and still learned from. An empty table gives no rows.
    """
    out = remainder(id_col, held_out) == 0
    model = fit(training_sample(docs.where(~out), id_col, text_col, lang_col))
    return label_documents(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a language, with all columns; those predicted ``und`` go.

    These are null, empty and letterless texts, and no others: where no row has a language to learn from, every text with a letter stays.
    Repeated rows and rows without an id are judged each; an empty table gives no rows.
    """
    model = fit(training_sample(docs.where(remainder(id_col, 5) != 0), id_col, text_col, lang_col))
    names = docs.columns

    def run(batches):
        labeller = Labeller(model)
        for b in batches:
            for at in range(0, b.num_rows, PASSED):
                part = b.slice(at, PASSED)
                texts = (t.as_py() for t in part.column(names.index(text_col)))
                keep = [g[0] != UNKNOWN for g in labeller.label(texts)] if model.languages else [bool(words_of(t)) for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))

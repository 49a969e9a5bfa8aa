"""Encoding and decoding with a sentencepiece byte-pair vocabulary, by vectorised merge rounds.

Distinct words of a batch lie end to end in flat numpy arrays of symbol numbers. A round finds the
smallest pair rank of every word, merges the leftmost non-overlapping pairs of that rank in
all words at once and compacts the arrays, until no word has a pair left. Ranks are looked up again only beside
merged places. Decoding gathers the bytes of all pieces of a batch in one step.

A merge may make a pair that ranks no later than itself, for which the pairs further right would have to wait. The
pieces with which that can happen are known from the vocabulary; where the neighbours of such a merge say that it does, a round merges
only the word's first pair.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Words above this many characters are merged one by one; characters of texts worked on at once; characters of remembered words.
LONG, AT_ONCE, REMEMBERED = 400, 1_000_000, 8_000_000


@dataclass
class Pieces:
    """Symbols of characters, pairs that merge, bytes of every piece."""

    symbol: np.ndarray  # symbol of each code point; the last symbol stands for characters in no piece
    pairs: np.ndarray  # left * n_symbols + right, sorted
    ranks: np.ndarray
    merged: np.ndarray
    risky: np.ndarray  # by symbol: a merge into it may make a pair of the same or a better rank
    n_symbols: int
    n_pieces: int
    byte_ids: np.ndarray
    longest_space: int  # blanks that may be cut off the front of a run at once, 0 if the vocabulary does not allow it
    data: np.ndarray  # bytes of all pieces as decoded, end to end
    starts: np.ndarray
    blank_first: np.ndarray  # by piece: begins with a blank that is dropped at the start of a text

    @classmethod
    def read(cls, path: str) -> Pieces:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ids = {texts[i]: i for i in normal}
        scores = {texts[i]: sp.get_score(i) for i in normal}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # Characters that occur in pieces without being one get symbols after those of the pieces.
        symbols = dict(ids)
        for c in sorted({c for t in ids for c in t} - set(ids)):
            symbols[c] = n + len(symbols) - len(ids)
        other = n + len(symbols) - len(ids)
        size = other + 1
        rows, rank_of = [], {t: order[scores[t]] for t in ids}
        risky = np.zeros(size, dtype=bool)
        for t, i in ids.items():
            for cut in range(1, len(t)):
                a, b = t[:cut], t[cut:]
                if a in symbols and b in symbols:
                    rows.append((symbols[a] * size + symbols[b], rank_of[t], i))
                for part in (a, b):
                    if len(part) > 1 and part in ids and a in symbols and b in symbols and rank_of[t] <= rank_of[part]:
                        risky[ids[part]] = True
        pairs, ranks, merged = (np.array(c, dtype=np.int64) for c in zip(*sorted(rows)))
        symbol = np.full(0x110000, other, dtype=np.int64)
        for t, s in symbols.items():
            if len(t) == 1:
                symbol[ord(t)] = s
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)

        out = []
        of_byte = {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
        for i in range(n):
            plain = b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else texts[i].replace(SPACE, " ").encode()
            out.append(of_byte.get(i, plain))
        starts = np.cumsum([0, *map(len, out)])
        v = cls(symbol, pairs, ranks, merged, risky, size, n, byte_ids, 0, np.frombuffer(b"".join(out), dtype=np.uint8), starts,
                np.array([t.startswith(SPACE) for t in texts]))
        blanks = [len(t) for t in ids if set(t) == {SPACE}]
        if len(blanks) > 1 and all(rank_of[SPACE * k] == len(order) - 1 for k in blanks):
            # Runs of blanks merge after everything else. If every longer run begins with the longest piece, that may be cut off.
            step = max(blanks)
            runs = [merge_rounds(np.full(k, ids[SPACE]), np.array([k]), v)[0].tolist() for k in range(1, 4 * step)]
            if all(runs[k] == [ids[SPACE * step], *runs[k - step]] for k in range(step, len(runs))):
                v.longest_space = step
        return v

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; the rank after all others where nothing merges."""
        key = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = self.pairs[at] == key
        return np.where(ok, self.ranks[at], self.none), self.merged[at]

    @property
    def none(self) -> int:
        return self.n_symbols


def _alternate(hit: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """In each run of overlapping pairs every second one, from the left. ``follows``: the place overlaps the hit before it."""
    place = np.arange(len(hit))
    start = np.maximum.accumulate(np.where(hit & ~follows, place, 0))
    return hit & ((place - start) % 2 == 0)


def merge_rounds(sym: np.ndarray, lengths: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Surviving symbols of words that lie end to end, and the place of each one's first character."""
    seq, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(sym))
    done_sym, done_place = [], []
    rank = np.full(len(sym), v.none)
    into = np.zeros(len(sym), dtype=np.int64)
    inside = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inside], into[inside] = v.look_up(sym[inside], sym[inside + 1])
    while len(sym):
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
        live = low < v.none
        hit = (rank == low) & live
        left = np.flatnonzero(_alternate(hit, np.append(False, hit[:-1])))
        bold = left[v.risky[into[left]]]
        if len(bold):
            # Words in which a later pair might have to wait merge their first pair only.
            new, last = into[bold], np.append(seq, -1)
            wait = (v.look_up(sym[bold - 1], new)[0] <= rank[bold]) & (bold > 0) & (last[bold - 1] == seq[bold])
            wait |= (v.look_up(new, np.append(sym, 0)[np.minimum(bold + 2, len(sym))])[0] <= rank[bold]) & (last[np.minimum(bold + 2, len(sym))] == seq[bold])
            wait |= v.look_up(new, new)[0] <= rank[bold]
            careful = np.zeros(len(lengths), dtype=bool)
            careful[seq[bold[wait]]] = True
            leader = np.append(True, seq[left[1:]] != seq[left[:-1]])
            left = left[leader | ~careful[seq[left]]]
        sym[left] = into[left]
        keep = live.copy()
        keep[left + 1] = False
        finished = ~live
        done_sym.append(sym[finished])
        done_place.append(place[finished])
        touched = np.zeros(len(sym), dtype=bool)
        touched[left] = True
        sym, seq, place, rank, into, touched = (a[keep] for a in (sym, seq, place, rank, into, touched))
        if not len(sym):
            break
        # Pairs that begin with a merged symbol or end with one.
        fresh = touched | np.append(touched[1:], False)
        inner = fresh & np.append(seq[:-1] == seq[1:], False)
        rank[fresh] = v.none
        where = np.flatnonzero(inner)
        rank[where], into[where] = v.look_up(sym[where], sym[where + 1])
    sym, place = np.concatenate(done_sym or [sym]), np.concatenate(done_place or [place])
    order = np.argsort(place, kind="stable")
    return sym[order], place[order]


def merge_long(sym: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The same rounds over one long word: symbols stay where they are and are linked, so a round costs what it merges."""
    place = np.arange(len(sym))
    while True:
        n = len(sym)
        nxt, prv = np.append(np.arange(1, n), n), np.arange(-1, n)  # n: beyond the end
        rank, into = np.full(n + 1, v.none), np.zeros(n + 1, dtype=np.int64)
        rank[:n - 1], into[:n - 1] = v.look_up(sym[:-1], sym[1:])
        gone, alive = np.zeros(n, dtype=bool), n
        while alive * 2 > n or n < 64:
            low = rank.min()
            if low == v.none:
                return sym[~gone], place[~gone]
            at = np.flatnonzero(rank == low)
            at = at[_alternate(np.ones(len(at), dtype=bool), np.append(False, nxt[at[:-1]] == at[1:]))]
            right = nxt[at]
            bold = v.risky[into[at]]
            if bold.any():
                new, end = into[at[bold]], np.append(sym, v.n_symbols - 1)
                wait = v.look_up(end[prv[at[bold]]], new)[0].min() <= low or v.look_up(new, end[nxt[right[bold]]])[0].min() <= low
                if wait or v.look_up(new, new)[0].min() <= low:
                    at, right = at[:1], right[:1]
            sym[at], gone[right], rank[right] = into[at], True, v.none
            nxt[at] = nxt[right]
            prv[nxt[at]] = at
            alive -= len(at)
            begin = np.unique(np.concatenate([at, prv[at]]))
            begin = begin[begin >= 0]
            after = nxt[begin]
            rank[begin] = v.none
            begin, after = begin[after < n], after[after < n]
            rank[begin], into[begin] = v.look_up(sym[begin], sym[after])
        sym, place = sym[~gone], place[~gone]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the slices that begin at ``starts``, one slice after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts; remembers the ids of words."""

    def __init__(self, v: Pieces):
        self.v = v
        self._forget()
        # A word is a run of blanks with what follows it: no piece has a blank behind another character.
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _forget(self) -> None:
        self.known, self.size = {}, 0
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _cut(self, word: str) -> list[str]:
        """Full runs of blanks off the front of a word: they all merge last, from the left."""
        step = self.v.longest_space
        if not step or not word.startswith(SPACE * (step + 1)):
            return [word]
        blanks = len(word) - len(word.lstrip(SPACE))
        cut = (blanks - 1) // step * step
        return [SPACE * step] * (cut // step) + [word[cut:]]

    def _learn(self, words: list[str]) -> None:
        v = self.v
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        sym = v.symbol[points]
        long = lengths > LONG
        parts = []
        for w in np.flatnonzero(long):
            at = slice(starts[w], starts[w] + lengths[w])
            s, p = merge_long(sym[at].copy(), v)
            parts.append((s, p + starts[w]))
        if not long.all():
            short = gather(starts[~long], lengths[~long])
            s, p = merge_rounds(sym[short], lengths[~long], v)
            parts.append((s, short[p]))
        out, place = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(place, kind="stable")
        out, place = out[order], place[order]
        word_of = np.searchsorted(starts, place, side="right") - 1
        # Characters that are no piece become their bytes.
        bare = np.flatnonzero(out >= v.n_pieces)
        if len(bare):
            raw = [chr(c).encode("utf-8") for c in points[place[bare]]]
            times = np.ones(len(out), dtype=np.int64)
            times[bare] = [len(r) for r in raw]
            at = np.cumsum(times) - times
            word_of, out = np.repeat(word_of, times), np.repeat(out, times)
            out[gather(at[bare], times[bare])] = v.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        counts = np.bincount(word_of, minlength=len(words))
        base = len(self.ids)
        self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts = np.append(self.starts, base + np.cumsum(counts) - counts)
        self.lengths = np.append(self.lengths, counts)
        self.ids = np.append(self.ids, out.astype(np.int32))
        self.size += len(points)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        if self.size > REMEMBERED:
            self._forget()
        words, counts = [], []
        for t in texts:
            found = self.words(SPACE + t.replace(" ", SPACE)) if t else []
            if self.v.longest_space and SPACE * (self.v.longest_space + 1) in t.replace(" ", SPACE) + SPACE:
                found = [p for w in found for p in self._cut(w)]
            words += found
            counts.append(len(found))
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            self._learn(fresh)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        flat = self.ids[gather(self.starts[at], self.lengths[at])]
        ends = np.append(0, np.cumsum(self.lengths[at]))[np.cumsum(counts)]
        return flat, np.diff(np.append(0, ends))


def _each_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("tidegrid-each-byte", _each_byte)


def decode(ids: np.ndarray, counts: np.ndarray, v: Pieces) -> list[str]:
    """Texts of ids that lie end to end. Bytes that form no character become one replacement character each."""
    ids = ids.astype(np.int64)
    begin, size = v.starts[ids], v.starts[ids + 1] - v.starts[ids]
    text_of = np.repeat(np.arange(len(counts)), counts)
    says = np.flatnonzero(size)
    head = says[np.append(True, text_of[says[1:]] != text_of[says[:-1]])] if len(says) else says
    strip = head[v.blank_first[ids[head]]]
    begin[strip] += 1
    size[strip] -= 1
    flat, reach = v.data[gather(begin, size)].tobytes(), np.append(0, np.cumsum(size))
    # Pieces that say nothing part the bytes beside them, so texts are decoded up to each of those.
    stops = np.sort(np.concatenate([np.flatnonzero(size == 0), np.cumsum(counts)]))
    ends = reach[stops].tolist()
    parts = [flat[a:b].decode("utf-8", "tidegrid-each-byte") for a, b in zip([0, *ends], ends)]
    if len(parts) == len(counts):
        return parts
    last = np.searchsorted(stops, np.cumsum(counts), side="right")
    return ["".join(parts[a:b]) for a, b in zip([0, *last.tolist()], last.tolist())]


def _slices(texts: list[str]):
    """Consecutive rows of about ``AT_ONCE`` characters; a longer text is a slice of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (array of piece ids of the whole text), ``decoded`` (those ids as text).

    ``path`` is a byte-pair model file of the sentencepiece library with byte fallback. No begin or end id is added, control
    pieces written in a text are ordinary characters. Null and empty texts have no ids and decode to the empty text. Texts of any
    length are encoded whole; one unbroken word costs time in proportion to its length times the number of ranks met in it.
    Repeated rows are encoded each, ids may repeat or be null, other columns are not read. An empty table gives
    no rows. The vocabulary, of fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.read(path))

    def run(batches):
        v = shared.value
        encoder = Encoder(v)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                flat, counts = encoder.encode(texts[lo:hi])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), ids, pa.array(decode(flat, counts, v), pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: id and ``decoded``, the text of an array of piece ids.

    Any ids of the vocabulary may follow each other. Null ids and empty arrays give the empty text; a number outside of the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.read(path))

    def run(batches):
        v = shared.value
        for b in batches:
            column = b.column(1).fill_null(pa.scalar([], b.column(1).type))
            ids = np.asarray(column.flatten())
            if len(ids) and (ids.min() < 0 or ids.max() >= v.n_pieces):
                raise ValueError("piece id outside of the vocabulary")
            counts = np.asarray(column.value_lengths()).astype(np.int64)
            yield pa.record_batch([b.column(0), pa.array(decode(ids, counts, v), pa.string())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(id_col, F.filter(ids_col, lambda i: i.isNotNull()).cast("array<int>"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

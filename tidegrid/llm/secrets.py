"""Secrets in texts: fixed patterns, and strings that compression can't explain.

Patterns find assignments, access keys and hex strings. Further candidates are all long strings
soon after sensitive words, names and values around equals signs apart. Each is measured by its marginal compressed bytes: a zstandard
compressor primed with a dictionary of the identifiers of all texts packs the surrounding text with and
without the candidate. Words and repeated names cost little; what stays incompressible is reported.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

# The three patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs; shorter ones would be dropped
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|auth|bearer|credential|private.?key|access.?key|signature|session.?id", re.IGNORECASE | re.ASCII)
SENSITIVE_PARTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "signature", "session")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST},}}")
PART = re.compile(r"[^=]+(?:=+\Z)?")
#: Characters after a sensitive word in which a candidate begins, surrounding text on either side, least marginal bytes per byte.
#: Nine in ten random keys (letters and digits, base64, hex) cost 0.93 and more, nine in ten identifiers of four words 0.84 and less.
REACH, AROUND, NOVEL = 48, 1024, 0.88
#: What counts as an identifier, words in parts of up to 64 characters. Size of the dictionary; identifiers it is trained on, several times what it
#: has room for; words of the text it is trained on, in which they are as frequent as in all documents. A word with less than one in ``SHARE`` of all
#: characters is none.
IDENTIFIER = r"[^\x20\x09-\x0D]{1,64}"
DICTIONARY, IDENTIFIERS, TRAINING_WORDS, SHARE = 16 * 1024, 8192, 300_000, 1 << 18
LEVEL = 6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    low, found = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def train_dictionary(samples: list[str]) -> bytes:
    """A zstandard dictionary of the identifiers in ``samples``; their plain text where they are too few to train on."""
    pieces = [s.encode()[i:i + 200] for s in samples for i in range(0, len(s), 200)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(pieces)[-DICTIONARY:]


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of names and values around the equals signs of a candidate that are long enough to be one themselves; padding stays."""
    found = [(start + m.start(), start + m.end()) for m in PART.finditer(text[start:end])]
    return [(s, e) for s, e in found if LEAST <= e - s < end - start]


def candidates(text: str, start: int):
    """Spans of candidates that begin within reach of ``start``; the text beyond it is read only as far as one goes on."""
    at, stop = start, start + REACH + LEAST
    while m := CANDIDATE.search(text, at, stop):
        span = CANDIDATE.match(text, m.start()).span()
        yield span
        at = span[1]


class Covered:
    """Parts of a text that spans cover."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        """A span that meets none yet."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


class Finder:
    """Finds all spans of texts; ``dictionary`` from ``train_dictionary`` may be empty."""

    def __init__(self, dictionary: bytes):
        primed = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **primed).compress

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes of text[start:end] per byte, after its surroundings without repeats of itself."""
        own = text[start:end].encode()
        around = (text[end:end + AROUND] + "\n" + text[max(0, start - AROUND):start]).encode().replace(own, b"")
        return (len(self.pack(around + own)) - len(self.pack(around))) / len(own)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of base and novel spans; novel ones overlap no base span."""
        found = base_spans(text)
        low = text.lower()
        if any(w in low for w in SENSITIVE_PARTS):
            seen, taken = set(), Covered(found)
            for word in SENSITIVE.finditer(text):
                for span in candidates(text, word.end()):
                    if span in seen:
                        continue
                    seen.add(span)
                    values = [v for v in parts(text, *span) if self.novel(text, *v, taken)]
                    if not values and self.novel(text, *span, taken):
                        values = [span]
                    for start, end in values:
                        found.append((start, 3, end))
                        taken.add(start, end)
        return sorted(found)

    def novel(self, text: str, start: int, end: int, taken: Covered) -> bool:
        return not taken.meets(start, end) and self.novelty(text, start, end) >= NOVEL


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def identifier_counts(docs: DataFrame, text_col: str) -> list[tuple[str, int]]:
    """The identifiers with most characters in all of ``docs`` and how often they occur, at least twice; equal ones in code-point order.

    All words of all texts are counted, long ones in parts. Only what a dictionary has room for comes to the driver.
    """
    text = F.col(text_col).cast("string")
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n") * F.length("word"))
    # Words with more than one in ``SHARE`` of all characters: fewer than that, however many tasks and words there are, so one task can put them in order.
    common = counts.where(F.col("size") * SHARE > docs.agg(F.sum(F.length(text))).scalar())
    most = stage(common.orderBy(F.col("size").desc(), "word").limit(IDENTIFIERS), "identifiers")
    return sorted(((r.word, r.n) for r in most.collect()), key=lambda x: (-x[1] * len(x[0]), x[0]))


def training_text(counts: list[tuple[str, int]]) -> list[str]:
    """Texts in which identifiers are about as frequent as counted, each at least once, in a fixed mixed order."""
    total = sum(n for _, n in counts)
    words = [w for w, n in counts for _ in range(max(1, round(TRAINING_WORDS * n / total)))]
    random.Random(0).shuffle(words)
    return [" ".join(words[i:i + 300]) for i in range(0, len(words), 300)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans as an array of (kind, start, end, value).

    Positions are code points, ends exclusive, in order of start, then kind. Null counts as empty; a text without
    secrets has an empty array. Repeated rows are scanned each. Other columns are not read. An empty table gives no rows.
    """
    dictionary = train_dictionary(training_text(identifier_counts(docs, text_col)))

    def run(batches):
        finder = Finder(dictionary)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for s, k, e in finder.spans(t)] for t in texts]
            yield pa.record_batch([b.column(0), pa.array(spans, SPANS)], [id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    counts = {f"n_{k}": F.size(of(k)).cast("long") for k in KINDS}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))

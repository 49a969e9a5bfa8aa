"""Main text of web pages through wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and text slots. Streams of all pages of one host are aligned one after
another, those of the same tags first. Where they mismatch, a run that follows its own repetition becomes a repeated group and a run that one
side lacks an optional group; aligned texts that differ become a slot, others stay constants.
In the wrapper each text has its place among the page's containers, and constants
are told from content, inside articles and outside. Every page is then aligned with its host's
wrapper and its texts in main slots are joined.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left
from difflib import SequenceMatcher
from functools import reduce
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Pages of a host, and share of them, that must agree before a text counts as a constant; layouts that a task merges, about, and that it holds before it
#: writes them out.
CONSTANT_PAGES, CONSTANT_SHARE, LAYOUTS, HELD = 3, 3 / 8, 32, 1000
#: Longest run of tokens that is looked at for a repetition.
LONGEST_REPEAT = 12
#: Runs of tokens that are unique on two pages anchor their alignment, longest first. Between anchors, tokens of up to this many pairs
#: are compared each with each; beyond that a match is looked for this far ahead.
ANCHORS, PAIRS, AHEAD = (8, 4, 2, 1), 1 << 18, 32

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))", re.DOTALL)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAMES = re.compile(r"[a-z]+(?:[^a-z\s]+[a-z]+)*")
WORDS = re.compile(r"[a-z]+")
HEADING = re.compile(r"<h[1-6][.>]")
# Elements of the HTML standard by what they are.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "select", "title", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "del", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset"}
MAIN = {"article", "main"}
ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "header", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "main", "hr"}
# Words of class, id and role that name what is not the article.
ASIDE_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
               "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion",
               "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Of these, words that in an article count alone only, not as part of a name such as ``share-price`` or ``entry-header``.
ALONE = {"banner", "comment", "footer", "header", "menu", "modal", "notice", "promotion", "related", "respond", "share", "social", "widget"}

Token = tuple[str, str]  # (signature, text); the signature of a text is "#"


def tokens(html: str) -> list[Token]:
    """Tags as ``<name.class.other-class>`` and ``</name>``, texts as written; comments, declarations and the insides of scripts and the like left out."""
    out: list[Token] = []
    said: list[str] = []  # parts of a text, which comments and scripts may cut
    pos, n = 0, len(html)

    def end_text() -> None:
        if said:
            out.append(("#", "".join(said)))
            said.clear()

    while pos < n:
        m = TOKEN.search(html, pos)
        stop = m.start() if m else n
        if stop > pos:
            said.append(html[pos:stop])
        if not m:
            break
        pos = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            end_text()
            out.append((f"</{name}>", ""))
            continue
        if name in RAW and not m["attrs"].rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, pos)
            pos = end.end() if end else n
            continue
        end_text()
        marks = sorted({w for _, *v in NAMED.findall(m["attrs"]) for w in ("-".join(WORDS.findall(x)) for x in NAMES.findall("".join(v).lower()))})
        out.append((f"<{name}{''.join('.' + w for w in marks)}>", ""))
    end_text()
    return out


def name_of(sig: str) -> str:
    return re.match(r"</?([^.>]*)", sig)[1]


def named_aside(name: str, marks: list[str], in_article: bool) -> bool:
    """Whether class, id or role name what is not the article. They say nothing of the page as a whole."""
    if not marks or name in MAIN or name in {"html", "body"}:
        return False
    return any(m in ASIDE_WORDS or any(w in ASIDE_WORDS and not (in_article and w in ALONE) for w in m.split("-")) for m in marks)


class Containers:
    """Paths of elements as numbers, each the child of another by its name; the page itself is 0."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.name = [-1], [""]

    def below(self, parent: int, name: str) -> int:
        if name in INLINE or name == "p":
            return parent
        n = self.number.setdefault((parent, name), len(self.parent))
        if n == len(self.parent):
            self.parent.append(parent)
            self.name.append(name)
        return n

    def within(self, tops: set[int]) -> list[bool]:
        """Whether each path is one of ``tops`` or below one."""
        out: list[bool] = []
        for n, parent in enumerate(self.parent):
            out.append(n in tops or parent >= 0 and out[parent])
        return out

    def within_homes(self, other: Containers, homes: set[int]) -> list[bool]:
        """Whether each path is, by its names, one of the paths ``homes`` of another page or below one."""
        at, out = [0], [0 in homes]
        for parent, name in zip(self.parent[1:], self.name[1:]):
            at.append(other.number.get((at[parent], name), -1))
            out.append(out[parent] or at[-1] in homes)
        return out


class Stack:
    """Open elements; each name knows its places, so that an end tag finds its element at once."""

    def __init__(self):
        self.open: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, *marks) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, *marks))

    def close(self, name: str) -> None:
        """End the innermost element of this name, with all in it."""
        if self.places.get(name):
            at = self.places[name][-1]
            for gone, *_ in self.open[at:]:
                self.places[gone].pop()
            del self.open[at:]


def places(sigs: list[str], plain: frozenset[int] = frozenset()) -> tuple[list[tuple[int, bool, bool, bool]], Containers]:
    """For each token: (container, in boilerplate, in an article, begins a block).

    Of elements opened by the tokens ``plain`` the names don't count; nor, where all articles are in elements so named, do those of the outermost.
    """
    stack, containers = Stack(), Containers()
    page = ("", False, False, None, 0)  # name, boilerplate, article, token of the outermost element that is boilerplate by name only, container
    out, free, around = [], False, set()
    for number, sig in enumerate(sigs):
        name = "" if sig == "#" else name_of(sig)
        if name and not sig.startswith("</"):
            if name in ENDS_P:
                stack.close("p")
            if name not in VOID:
                up = stack.open[-1] if stack.open else page
                element = name in BOILERPLATE
                named = not element and number not in plain and named_aside(name, sig[1:-1].split(".")[1:], up[2])
                if name in MAIN and not up[2]:
                    free |= not up[1]
                    if up[3] is not None:
                        around.add(up[3])
                stack.push(name, up[1] or element or named, up[2] or name in MAIN, up[3] if up[1] else number if named else None, containers.below(up[4], name))
        elif name:
            stack.close(name)
        top = stack.open[-1] if stack.open else page
        out.append((top[4], top[1], top[2], bool(name) and name not in INLINE))
    if free or not around:
        return out, containers
    return places(sigs, plain | around if len(plain) < 4 else frozenset(range(len(sigs))))


def widest_aside(page: list[Token]) -> frozenset[int]:
    """The token that opens the element with most text of those that are boilerplate by name, outermost first."""
    sigs = [s for s, _ in page]
    before, _ = places(sigs)
    weight: dict[int, int] = {}
    opener = None
    for n, (sig, text) in enumerate(page):
        if not before[n][1]:
            opener = None
        elif opener is None or before[n][0] == before[opener][0] and sig == sigs[opener]:
            opener = n
        if opener is not None:
            weight[opener] = weight.get(opener, 0) + len(text.strip())
    named = {n: w for n, w in weight.items() if w and sigs[n] != "#" and name_of(sigs[n]) not in BOILERPLATE}
    return frozenset([max(named, key=lambda n: (named[n], -n))]) if named else frozenset()


def _repeatable(run: list[list]) -> bool:
    """Whether a run can stand for a repetition: what it opens it closes, but for paragraphs and inline tags."""
    open_names: list[str] = []
    for sig, *_ in run:
        name = "" if sig == "#" else name_of(sig)
        if name in VOID or name in INLINE or name in {"", "p", "li", "dt", "dd"}:
            continue
        if not sig.startswith("</"):
            open_names.append(name)
        elif not open_names or open_names.pop() != name:
            return False
    return not open_names and not run[0][0].startswith("</")


def collapsed(page: list[Token]) -> list[list]:
    """Entries [signature, texts, token numbers, repeated]: runs that follow an equal run are folded into it."""
    out: list[list] = []
    for number, (sig, text) in enumerate(page):
        out.append([sig, [text], [number], False])
        folded = True
        while folded:
            folded = False
            for k in range(1, min(LONGEST_REPEAT, len(out) // 2) + 1):
                if out[-1][0] == out[-1 - k][0] and all(out[-i][0] == out[-i - k][0] for i in range(1, k + 1)) and _repeatable(out[-k:]):
                    for a, b in zip(out[-2 * k:-k], out[-k:]):
                        a[1].extend(b[1])
                        a[2].extend(b[2])
                        a[3] = True
                    del out[-k:]
                    folded = True
                    break
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs ordered by their first numbers, a longest series whose second numbers rise too."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = last[at - 1] if at else -1
        tails[at:at + 1] = [j]
        last[at:at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _unique_runs(s: list[str], lo: int, hi: int, n: int) -> dict[tuple[str, ...], int]:
    """Runs of ``n`` tokens that occur once, and where."""
    found: dict[tuple[str, ...], int] = {}
    for i in range(lo, hi - n + 1):
        run = tuple(s[i:i + n])
        found[run] = -1 if run in found else i
    return {run: i for run, i in found.items() if i >= 0}


def _anchors(a: list[str], b: list[str], i: int, i2: int, j: int, j2: int) -> list[tuple[int, int]]:
    """Positions that match because they begin runs that are unique on both sides."""
    for n in ANCHORS:
        there = _unique_runs(b, j, j2, n)
        pairs = _rising([(x, there[run]) for run, x in _unique_runs(a, i, i2, n).items() if run in there])
        if pairs:
            return pairs
    return []


def _looking_ahead(a: list[str], b: list[str], i: int, i2: int, j: int, j2: int):
    """Matches from the left, each the nearest within ``AHEAD`` tokens."""
    while i < i2 and j < j2:
        skip = next(((x, d - x) for d in range(min(AHEAD, i2 - i + j2 - j)) for x in range(d + 1)
                     if i + x < i2 and j + d - x < j2 and a[i + x] == b[j + d - x]), None)
        if skip:
            i, j = i + skip[0], j + skip[1]
            yield i, j
            i, j = i + 1, j + 1
        else:
            i, j = i + AHEAD // 2, j + AHEAD // 2


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of equal tokens, both rising: equal ends first, then what lies between anchors."""
    found, open_runs = [], [(0, len(a), 0, len(b), 0)]
    while open_runs:
        i, i2, j, j2, depth = open_runs.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            found.append((i2, j2))
        if i == i2 or j == j2:
            continue
        # So deep only where each anchor parts off a few tokens.
        anchors = _anchors(a, b, i, i2, j, j2) if depth < 32 else []
        if anchors:
            for (x, y), (x2, y2) in zip([(i, j), *anchors], [*anchors, (i2, j2)]):
                open_runs.append((x, x2, y, y2, depth + 1))
        elif (i2 - i) * (j2 - j) <= PAIRS:
            for x, y, n in SequenceMatcher(None, a[i:i2], b[j:j2], autojunk=False).get_matching_blocks():
                found += zip(range(i + x, i + x + n), range(j + y, j + y + n))
        else:
            found += _looking_ahead(a, b, i, i2, j, j2)
    return sorted(found)


def aligned(a: list[str], b: list[str]):
    """Pairs of positions that match, in order; runs without a partner have None on the other side."""
    i = j = 0
    for x, y in [*_matches(a, b), (len(a), len(b))]:
        yield from ((k, None) for k in range(i, x))
        yield from ((None, k) for k in range(j, y))
        if x < len(a):
            yield x, y
        i, j = x + 1, y + 1


def layout(page: list[Token]) -> list[list]:
    """Wrapper of one page: entries [signature, constant text or null, pages agreeing, optional, repeated, set of texts]."""
    return [[sig, " ".join("".join(t).split()) if not rep else None, 1, False, rep, {" ".join(x.split()) for x in t}] for sig, t, _, rep in collapsed(page)]


def both(u: list, v: list) -> list:
    """Two entries that match as one. The order in which entries are put together does not matter."""
    return [u[0], u[1] if u[1] is not None and u[1] == v[1] else None, u[2] + v[2], u[3] or v[3], u[4] or v[4], u[5] & v[5]]


def merged(a: list[list], b: list[list]) -> list[list]:
    """Two wrappers as one; what one of them lacks is optional."""
    out = []
    for i, j in aligned([w[0] for w in a], [w[0] for w in b]):
        if i is None or j is None:
            entry = list(b[j] if i is None else a[i])
            entry[3] = True
        else:
            entry = both(a[i], b[j])
        out.append(entry)
    return out


def finished(wrapper: list[list], pages: int) -> list[list]:
    """With whether enough of the ``pages`` agree in place of their number, and the constants in place of the texts: those that each of the agreeing pages
    has there; of a repeated entry they may be several. A passage that only a few pages of a large host share makes no constant."""
    enough = max(CONSTANT_PAGES, math.ceil(pages * CONSTANT_SHARE))
    return [[*w[:2], w[2] >= enough, *w[3:5], sorted(w[5] - {""}) if w[2] >= enough else []] for w in wrapper]


def infer(pages: list[list[Token]]) -> list[list]:
    """Wrapper of pages: entries [signature, constant text or null, whether enough pages agree, optional, repeated, constants]."""
    return finished(reduce(merged, map(layout, pages)), len(pages)) if pages else []


def written(wrapper: list[list]) -> str:
    return json.dumps([[*w[:5], sorted(w[5])] for w in wrapper])


def read(text: str) -> list[list]:
    return [[*w[:5], set(w[5])] for w in json.loads(text)]


def expression(wrapper: list[list]) -> str:
    """The wrapper as one regular expression without unions: #, constants, ( )? and ( )+."""
    parts, at = [], 0
    while at < len(wrapper):
        kind = tuple(wrapper[at][3:5])
        end = at
        while end < len(wrapper) and tuple(wrapper[end][3:5]) == kind:
            end += 1
        body = " ".join((w[1] or "#") if w[0] == "#" else w[0] for w in wrapper[at:end])
        parts.append(f"( {body} ){'?' if kind[0] else ''}{'+' if kind[1] else ''}" if any(kind) else body)
        at = end
    return " ".join(parts)


def main_slots(wrapper: list[list]) -> list[bool]:
    """Whether each entry's text is main text.

    Texts of articles outside boilerplate; where the wrapper has no article, the slots (not the
    constants of several pages) of the container with most text entries that are no boilerplate.
    """
    where, containers = places([w[0] for w in wrapper])
    texts = [i for i, w in enumerate(wrapper) if w[0] == "#" and not where[i][1]]
    if any(where[i][2] for i in texts):
        chosen = {i for i in texts if where[i][2]}
    else:
        slots = [i for i in texts if not (wrapper[i][1] is not None and wrapper[i][2])]
        weight: dict[int, int] = {}
        for i in slots:
            weight[where[i][0]] = weight.get(where[i][0], 0) + (2 if wrapper[i][4] else 1)
        inside = containers.within({max(weight, key=lambda c: (weight[c], -c))} if weight else set())
        chosen = {i for i in slots if inside[where[i][0]]}
    return [i in chosen for i in range(len(wrapper))]


def joined(blocks) -> str:
    return " ".join(b for b in (" ".join(x.split()) for lines in blocks for x in lines) if b)


def homes_of(wrapper: list[list], slots: list[bool]) -> tuple[Containers, set[int]]:
    """Containers of the wrapper, and those of the main slots."""
    where, containers = places([w[0] for w in wrapper])
    return containers, {w[0] for w, s in zip(where, slots) if s}


def extract(html: str | None, wrapper: list[list] | None = None, slots: list[bool] | None = None, homes: tuple[Containers, set[int]] | None = None) -> str:
    """Main text of one page; without a wrapper, by the page alone.

    In articles, blocks whose texts are all constants of the wrapper go, unless nothing else is left; headings stay where what they head stays. Without an article, texts
    that the wrapper lacks are main text in or below the containers of main slots, ``homes``.
    """
    page = tokens(html or "")
    if not any(s == "#" and t.strip() for s, t in page):
        return ""
    own = collapsed(page)
    if not wrapper:
        wrapper = [[sig, None, False, False, rep, []] for sig, _, _, rep in own]
        slots, homes = main_slots(wrapper), None
    where, containers = places([s for s, _ in page])
    at_home = containers.within_homes(*(homes or homes_of(wrapper, slots)))
    articled = any(w[2] and not w[1] for w, (s, t) in zip(where, page) if s == "#" and t.strip())
    main: set[int] = set()
    constant: set[int] = set()
    for i, j in aligned([w[0] for w in wrapper], [o[0] for o in own]):
        if j is not None and own[j][0] == "#":
            # A repeated entry may stand in several places, so each text is also held against its own.
            main.update(n for n in own[j][2] if not where[n][1] and (where[n][2] if articled else slots[i] if i is not None else at_home[where[n][0]]))
            if articled and i is not None and wrapper[i][5]:
                constant.update(n for n in own[j][2] if " ".join(page[n][1].split()) in wrapper[i][5])
    if not main:  # the wrapper has no place for this page's text
        alone = [[sig, None, False, False, rep, []] for sig, _, _, rep in own]
        main = {n for o, s in zip(own, main_slots(alone)) if s for n in o[2] if not where[n][1]}
    if not any(page[n][1].strip() for n in main):  # all is boilerplate by name: a layout, not an aside
        where, _ = places([s for s, _ in page], widest_aside(page))
        main = {n for n, (s, _) in enumerate(page) if s == "#" and not where[n][1]}
    blocks, now = [[]], []  # lists of lines
    own_text: set[int] = set()  # blocks with more than constants
    headings: set[int] = set()
    for n, (sig, text) in enumerate(page):
        if where[n][3] and now:
            blocks[-1].append("".join(now))
            now = []
        if where[n][3] and name_of(sig) not in VOID:
            if blocks[-1]:
                blocks.append([])
            (headings.add if HEADING.match(sig) else headings.discard)(len(blocks) - 1)
        if n in main:
            now.append(unescape(text))
            if n not in constant and text.strip():
                own_text.add(len(blocks) - 1)
    blocks[-1].append("".join(now))
    headed = False
    for i in range(len(blocks) - 1, -1, -1):
        if i in own_text or i in headings and headed:
            own_text.add(i)
            headed = True
        elif any(line.strip() for line in blocks[i]):
            headed = False
    return joined(b for i, b in enumerate(blocks) if i in own_text) or joined(blocks)


def host(url: str) -> F.Column:
    """Host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_layouts(pages: DataFrame) -> DataFrame:
    """(host, layout, n, wrapper): pages (host, html) of the same tags as one wrapper, from all pages; n is their number."""

    def partial(batches):
        found: dict[tuple[str, bytes], list] = {}

        def rows():
            hosts, layouts = zip(*found)
            counts, wrappers = zip(*found.values())
            return pa.record_batch([pa.array(hosts), pa.array(layouts, pa.binary()), pa.array(counts, pa.int64()), pa.array(map(written, wrappers))], names)

        for b in batches:
            for host_, html in zip(b.column("host"), b.column("html")):
                new = layout(tokens(html.as_py() or ""))
                if not new:
                    continue
                key = host_.as_py(), hashlib.sha256("".join(w[0] for w in new).encode("utf-8", "replace")).digest()
                if key in found:
                    n, old = found[key]
                    found[key] = [n + 1, [both(u, v) for u, v in zip(old, new)]]
                else:
                    found[key] = [1, new]
                if len(found) >= HELD:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    def whole(key, t):
        wrapper = reduce(lambda a, b: [both(u, v) for u, v in zip(a, b)], map(read, t.column("wrapper").to_pylist()))
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.binary()), pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([written(wrapper)])], names)

    names, kinds = ["host", "layout", "n", "wrapper"], "host string, layout binary, n long, wrapper string"
    return pages.mapInArrow(partial, kinds).groupBy("host", "layout").applyInArrow(whole, kinds)


def infer_wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, expression), inferred from all pages of each host; of pages that are equal, one.

    Pages with the same tags are put together first, in any order. Of these layouts up to about ``LAYOUTS`` are merged in a task, the most common first,
    and the results again, until a host has one wrapper.
    """
    own = pages.select(host(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).where("html is not null").distinct()
    rows = stage(page_layouts(own), "layouts")

    def run(key, t):
        order = sorted(t.select(["layout", "n", "wrapper"]).to_pylist(), key=lambda r: (-r["n"], r["layout"]))
        wrapper = reduce(merged, (read(r["wrapper"]) for r in order))
        return pa.table([pa.array([key[0].as_py()]), pa.array([order[0]["layout"]], pa.binary()), pa.array([sum(r["n"] for r in order)], pa.int64()), pa.array([written(wrapper)])], ["host", "layout", "n", "wrapper"])

    turn = 0
    while True:
        # Written, so that its size is known and wrappers are not shuffled by host to learn of their number.
        counts = stage(rows.groupBy("host").agg(F.count(F.lit(1)).alias("rows")), "host-counts")
        if (counts.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
        group = F.pmod(F.xxhash64("layout", F.lit(turn)), F.ceil(F.col("rows") / LAYOUTS)).alias("group")
        rows = stage(rows.join(counts, "host").select("host", group, "layout", "n", "wrapper").groupBy("host", "group").applyInArrow(run, "host string, layout binary, n long, wrapper string"), "layouts")
        turn += 1

    def close(batches):
        for b in batches:
            found = [finished(read(w), n) for w, n in zip(b.column("wrapper").to_pylist(), b.column("n").to_pylist())]
            yield pa.record_batch([b.column("host"), pa.array([json.dumps(w) for w in found], pa.string()), pa.array([expression(w) for w in found], pa.string())], ["host", "wrapper", "expression"])

    return rows.mapInArrow(close, "host string, wrapper string, expression string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null, empty and textless pages give an empty text. Pages without a host share a wrapper. A page whose
    text has no place in its host's wrapper is taken by itself. Repeated rows give equal results; nothing is cut. An empty table
    gives no rows. Wrappers, a few kilobytes a host, are joined by host; a hot host's pages stay where they are or are split.
    """
    wrappers = stage(infer_wrappers(pages, id_col, url_col, html_col).select("host", "wrapper"), "wrappers")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host(url_col).alias("host"))
    joined = rows.join(wrappers, "host", "left").select("id", "url", "html", "wrapper")

    def run(batches):
        known: dict[str | None, tuple] = {}
        for b in batches:
            texts = []
            for html, w in zip(b.column("html"), b.column("wrapper")):
                key = w.as_py()
                if key not in known:
                    if len(known) >= 256:
                        known.clear()
                    entries = json.loads(key) if key else []
                    slots = main_slots(entries)
                    known[key] = (entries, slots, homes_of(entries, slots))
                texts.append(extract(html.as_py(), *known[key]))
            yield pa.record_batch([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return joined.mapInArrow(run, f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string, n_chars long")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

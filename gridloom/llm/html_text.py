"""Main text of web pages by differencing against the nearest pages of the host, with element structure as evidence.

Parsing splits a page into blocks of text (lines) and marks each: *boilerplate* inside
menus, headers, footers, asides, forms, adverts, notices, comments and the like (by
element, role, class or id), *article* inside an article element, else *open*, also in main.
Scripts, styles, comments and markup never reach a line.

Differencing orders pages by host and URL path, pairs each with the nearest page of its host
that is no copy (shares at most COPY of its text outside of boilerplate) and aligns the lines
of both by longest common subsequence. Shared open lines are deleted. Structure only vetoes:
a shared article line stays, as two articles may well quote one paragraph, and a boilerplate
line goes though no neighbour has it. Every page is aligned; n_shared tells with what result.

Pages of a host with equal lines are one class and get one text. Classes lie in ranges, so that a
host with a third of all pages spreads over many tasks; every range also gets the NEIGHBOURS
classes before and after it, so texts do not depend on where ranges end. A class that finds
only copies asks again after every run of copies has been reduced to its first member.

Defined results: null html gives an empty text; a null url counts as the empty host and
path; repeated pages are reported once each; an empty table gives an empty table; other
columns are ignored. Very long pages are read whole; their alignment is split in halves until
its table fits. Cut-off pages end where they end: open elements are closed there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches, discard, group_ranges, materialize, small_batches, whole_groups

#: Fixed vocabularies of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select canvas audio video noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
FRAME = frozenset("nav aside footer header form dialog menu button label".split())
FRAME_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A word of a class or id that names a frame: these words alone, or as the last or first part of a compound.
FRAME_WORDS = (
    r"(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|promos?|promotions?|sponsor(?:ed|s)?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|footers?|headers?|masthead|"
    r"topbar|cookies?|consent|gdpr|notices?|alerts?|newsletters?|subscribe|subscription|social|shar(?:e|ing)|related|recommend(?:ed|ations?)|comments?|commentlist|disqus|repl(?:y|ies)|respond|popups?|modals?|overlay|"
    r"log-?in|sign-?up|search|pagination|pager|toolbar|widgets?|skip(?:-link)?|copyright|legal|tags|byline-links|teasers?)"
)
FRAME_NAME = re.compile(rf"(?:[a-z\d]+[_-])*{FRAME_WORDS}\d*(?:[_-](?:{FRAME_WORDS}|area|bar|block|bottom|box|card|column|container|feed|form|grid|content|inner|item|left|links?|list|main|note|outer|panel|primary|right|row|secondary|section|slot|text|top|unit|wrap(?:per)?|\d+))*", re.I)
#: Parts that make a compound speak of a frame elsewhere: "no-sidebar", "has-header".
LAYOUT_PART = re.compile(r"(?:^|[_-])(?:no|not|non|has|have|with|without|is|in|hide|show|page|site-main|post)[_-]", re.I)
COMMENTS = re.compile(r"comment|disqus|repl(?:y|ies)|respond", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")

OPEN, ARTICLE, BOILERPLATE = 0, 1, 2
#: Pages asked on either side at a time.
NEIGHBOURS = 3
#: Classes of pages in a range; texts do not depend on it.
PAGES_A_TASK = 4000
#: A neighbour sharing more of a page's open and article text than this is a copy.
COPY = 0.8


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(key.lower(), "".join(values)) for key, *values in ATTRIBUTE.findall(text)]


def _names_frame(value: str) -> bool:
    """Whether a word of a class or id names a frame: "comment", "site-footer", "ad-slot", not "no-sidebar" or "search-results"."""
    return any(FRAME_NAME.fullmatch(x) and not LAYOUT_PART.search(x) for x in value.split())


def _is_frame(name: str, attributes: list[tuple[str, str]]) -> str:
    """Why an element is a frame: "element" (also by role, hidden, or as comments), "named" (by another class or id), else ""."""
    if name in FRAME:
        return "element"
    named = ""
    for key, value in attributes:
        if key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true" or key == "style" and NO_DISPLAY.search(value) or key == "role" and value.lower() in FRAME_ROLE:
            return "element"
        if key in ("class", "id") and _names_frame(value):
            named = "element" if COMMENTS.search(value) else named or "named"
    return named


def parse(page: str) -> list[tuple[str, int]]:
    """The page's lines and their marks, in page order.

    A class or id around the page's only articles speaks of its layout, and is read as no frame,
    unless it names comments or the page has more text outside of it."""
    lines, around = _parse(page, frozenset())
    if around and not any(mark == ARTICLE for _, mark in lines):
        inside, _ = _parse(page, around)
        if sum(len(t) for t, mark in lines if mark == OPEN) < sum(len(t) for t, mark in inside if mark == ARTICLE):
            return inside
    return lines


def _parse(page: str, layout: frozenset[int]) -> tuple[list[tuple[str, int]], frozenset[int]]:
    """Lines with marks, and where the named frames begin that hold article elements and are in no other frame."""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, str, int]] = []  # name, what it begins ("element", "named", "article" or ""), where
    frames = articles = 0
    around: set[int] = set()
    parts: list[str] = []
    pos, n, quoted = 0, len(page), True
    lowered = None

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                lines.append((text, BOILERPLATE if frames else ARTICLE if articles else OPEN))

    def pop(to: int) -> None:
        nonlocal frames, articles
        while len(stack) > to:
            kind = stack.pop()[1]
            frames -= kind in ("element", "named")
            articles -= kind == "article"

    while pos < n:
        i = page.find("<", pos)
        if i < 0:
            parts.append(page[pos:])
            break
        if i > pos:
            parts.append(page[pos:i])
        after = page[i + 1 : i + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                pos = n if j < 0 else j + 3
            else:
                j = page.find(">", i)
                pos = n if j < 0 else j + 1
            continue
        if not (after.isalpha() and after.isascii() or after == "/"):
            parts.append("<")
            pos = i + 1
            continue
        m = TAG.match(page, i) if quoted else None
        if m:
            closing, name, attributes, pos = m[1], m[2].lower(), m[3], m.end()
        else:
            j = page.find(">", i)
            if j < 0:
                break  # cut off inside a tag
            quoted = quoted and after == "/"  # one unbalanced quote, and quotes are no longer followed
            words = page[i + 1 : j].lstrip("/").split(None, 1)
            closing, name, attributes, pos = after if after == "/" else "", words[0].lower() if words else "", words[1] if len(words) > 1 else "", j + 1
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in RAW and not attributes.endswith("/"):
            if lowered is None:
                lowered = page.lower() if page.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), page)
            j = lowered.find(f"</{name}", pos)
            if j < 0:
                break
            j = page.find(">", j)
            pos = n if j < 0 else j + 1
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        has = _attributes(attributes) if attributes else []
        kind = ""
        if name == "article" and any(key in ("class", "id") and _names_frame(value) for key, value in has):
            kind = "element"  # a comment, a teaser
        elif name == "article" or any(key == "itemprop" and value == "articleBody" for key, value in has):
            kind = "article"
            if frames and all(k != "element" for _, k, _ in stack):
                around.update(at for _, k, at in stack if k == "named")
        elif name in ("html", "body", "main") or any(key == "role" and value.lower() == "main" for key, value in has):
            pass
        elif name == "header" and articles and not frames:
            pass  # the article's own head holds its title
        elif i not in layout:
            kind = _is_frame(name, has)
        frames += kind in ("element", "named")
        articles += kind == "article"
        stack.append((name, kind, i))
    flush()
    return lines, frozenset(around)


def common(a: list[int], b: list[int]) -> np.ndarray:
    """Which items of a stand in a longest common subsequence with b. Bit-parallel rows, split in halves where they would not fit."""
    out = np.zeros(len(a), bool)

    def rows(x: list[int], y: list[int], keep: bool):
        where: dict[int, int] = {}
        for j, item in enumerate(y):
            where[item] = where.get(item, 0) | 1 << j
        full = (1 << len(y)) - 1
        v, held = full, []
        for item in x:
            u = v & where.get(item, 0)
            v = ((v + u) | (v - u)) & full
            if keep:
                held.append(v)
        return v, held

    def lengths(v: int, size: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(v.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size]
        return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out[a1 - 1] = True
            a1, b1 = a1 - 1, b1 - 1
        shared = set(a[a0:a1]) & set(b[b0:b1])
        if not shared:
            continue
        if (a1 - a0) * (b1 - b0) > 1 << 28 and a1 - a0 > 1:
            mid = (a0 + a1) // 2
            left = lengths(rows(a[a0:mid], b[b0:b1], False)[0], b1 - b0)
            right = lengths(rows(a[mid:a1][::-1], b[b0:b1][::-1], False)[0], b1 - b0)[::-1]
            cut = b0 + int(np.argmax(left + right))
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
            continue
        _, held = rows(a[a0:a1], b[b0:b1], True)
        i, j = a1 - a0 - 1, b1 - b0 - 1
        while i >= 0 and j >= 0:
            if held[i] >> j & 1:  # b[j] adds nothing to row i
                j -= 1
            elif i and not held[i - 1] >> j & 1:  # nor does a[i] at b[j]
                i -= 1
            else:
                out[a0 + i] = True
                i, j = i - 1, j - 1
    return out


def _place(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", url or "")
    # Numbers in a path sort by value, so that neighbours are pages of one kind.
    return host, re.sub(r"\d+", lambda x: x[0].lstrip("0").zfill(12), path.rstrip("/"))


def _line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) >> 1


def _told(url: str | None, page: str | None) -> tuple[list[tuple[str, int]], str, str, bytes, list[int]]:
    """A page's lines, host, path, the digest of its class, and what its lines are told by."""
    lines = parse(page or "")
    host, path = _place(url)
    told = [_line_id(t) for t, _ in lines]
    marks = bytes(k for _, k in lines)
    return lines, host, path, xxhash.xxh3_128_digest(b"\0".join([host.encode("utf-8", "replace"), marks, np.array(told, np.int64).tobytes()])), told


def _lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        rows = [_told(u, h) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({
            "digest": pa.array([r[3] for r in rows], pa.binary()), "host": pa.array([r[1] for r in rows], pa.string()), "path": pa.array([r[2] for r in rows], pa.string()),
            "lines": pa.array([np.array(r[4], np.int64).tobytes() for r in rows], pa.binary()), "marks": pa.array([bytes(k for _, k in r[0]) for r in rows], pa.binary()),
            "sizes": pa.array([np.array([len(t) for t, _ in r[0]], np.int32).tobytes() for r in rows], pa.binary()),
        })


def _bodies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        rows = [_told(u, h) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        body = [[t for t, k in r[0] if k != BOILERPLATE] for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[3] for r in rows], pa.binary()), pa.array(body, pa.list_(pa.string()))], ["page_id", "url", "digest", "body"])


class Told:
    """What tells a class of pages, unpacked once."""

    def __init__(self, row: dict):
        self.row, self.host = row, row["host"]
        self.lines = np.frombuffer(row["lines"], np.int64).tolist()
        self.marks = np.frombuffer(row["marks"], np.uint8)
        self.sizes = np.where(self.marks == BOILERPLATE, 0, np.frombuffer(row["sizes"], np.int32)).astype(np.int64)

    def shared(self, other: Told) -> tuple[np.ndarray, bool]:
        """Lines that the other has too, in one order, and whether these make the page a copy of it."""
        both = common(self.lines, other.lines)
        return both, bool(self.sizes[both].sum() > COPY * self.sizes.sum())


def ask(page: Told, before: list[Told], after: list[Told]) -> tuple[np.ndarray | None, bool, bool]:
    """Lines shared with the nearest page that is no copy; whether more pages must be asked; whether the page before is a copy.

    before, after: by distance, nearest first, NEIGHBOURS at most."""
    sides = [[x for x in side if x.host == page.host] for side in (before, after)]
    shared, follows = None, False
    for d in range(NEIGHBOURS):
        for at, side in enumerate(sides):
            if d < len(side) and (shared is None or not (d or at)):
                both, copy = page.shared(side[d])
                follows |= copy and not (d or at)
                if not copy and shared is None:
                    shared = both
    more = shared is None and any(len(side) == NEIGHBOURS for side in sides)
    return shared, more, follows


_CLASS = "digest binary, host string, path string, lines binary, marks binary, sizes binary, asks boolean, offers boolean"


def _numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class with its range, its place there, and how many that offer themselves stand before it."""
    r, at, before = TaskContext.get().partitionId(), 0, 0
    for b in batches(it):
        offers = b.column("offers").to_numpy(zero_copy_only=False).astype(np.int64)
        ahead = before + np.cumsum(offers) - offers
        fields = [pa.array(np.full(b.num_rows, r, np.int32)), pa.array(np.arange(at, at + b.num_rows)), pa.array(ahead)]
        yield pa.RecordBatch.from_arrays([*b.columns, *fields], [*b.schema.names, "r", "at", "ahead"])
        at, before = at + b.num_rows, before + int(offers.sum())


def _differenced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for the classes of a range (side 0), which comes with those before (-1) and after it (1)."""
    for t in whole_groups(it, 1, rows=1):
        for a, b in group_ranges(t, 1):
            out = []
            window: list[Told] = []  # the offers around the page in turn
            rows = (Told(x) for batch in t.slice(a, b - a).to_batches(max_chunksize=256) for x in batch.to_pylist())
            waiting: list[tuple[Told, list[Told]]] = []  # pages that still miss offers after them

            def answer(page: Told, before: list[Told], after: list[Told], out: list = out) -> None:
                shared, more, follows = ask(page, before, after)
                gone = None if shared is None else (shared & (page.marks == OPEN))[page.marks != BOILERPLATE]
                out.append((page.row["digest"], page.row["asks"], more, follows, gone.tolist() if gone is not None and gone.any() else None, 0 if shared is None else int(shared.sum())))

            after: list[list[Told]] = []
            for x in rows:
                if x.row["offers"]:
                    for later in after:
                        later.append(x)
                    while waiting and len(after[0]) == NEIGHBOURS:
                        answer(*waiting.pop(0), after.pop(0))
                if x.row["side"] == 0:
                    waiting.append((x, window[::-1]))
                    after.append([])
                if x.row["offers"]:
                    window = [*window, x][-NEIGHBOURS:]
            while waiting:
                answer(*waiting.pop(0), after.pop(0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.bool_()), pa.int64()))], ["digest", "asks", "more", "follows", "gone", "n_shared"])


def _round(classes: DataFrame, n: int) -> DataFrame:
    """(digest, asks, more, follows, gone, n_shared) of all classes, given who asks and who offers itself."""
    order = ["host", "path", "digest"]
    placed = materialize(classes.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_numbered, _CLASS + ", r int, at long, ahead long"))
    # Of each range the first and last offers, and of the ranges around it as many as have them: windows over one row for each range.
    offers = placed.where("offers")
    last = offers.groupBy("r").agg(F.max("ahead").alias("last"))
    ends = offers.select("r", "digest", "at", "ahead").join(last.hint("merge"), "r").where(F.expr(f"ahead < {NEIGHBOURS} or ahead > last - {NEIGHBOURS}"))
    entry = F.struct("r", "at", "digest")
    having = ends.groupBy("r").agg(F.collect_list(F.when(F.col("ahead") < NEIGHBOURS, entry)).alias("head"), F.collect_list(F.when(F.col("ahead") > F.col("last") - NEIGHBOURS, entry)).alias("tail"))
    near = Window.orderBy("r")

    def some(lists: str, first: int, to: int, ascending: bool) -> Column:
        return F.slice(F.sort_array(F.flatten(F.collect_list(lists).over(near.rowsBetween(first, to))), asc=ascending), 1, NEIGHBOURS)

    having = having.select("r", F.row_number().over(near).alias("g"), some("tail", 1 - NEIGHBOURS, 0, False).alias("before"), some("head", 0, NEIGHBOURS - 1, True).alias("after"))
    every = placed.groupBy("r").agg(F.max("offers").alias("has")).withColumn("g", F.sum(F.col("has").cast("int")).over(near).cast("int"))
    before = every.select("r", F.expr("g - int(has)").alias("g")).join(having.select("g", F.explode("before").alias("e")), "g").select("r", F.lit(-1).alias("side"), "e")
    after = every.select("r", F.expr("g + 1").alias("g")).join(having.select("g", F.explode("after").alias("e")), "g").select("r", F.lit(1).alias("side"), "e")
    halo = before.unionByName(after).select("r", "side", F.col("e.r").alias("at_r"), F.col("e.at").alias("at"), F.col("e.digest").alias("digest"))
    told = ["digest", "host", "lines", "marks", "sizes", "asks", "offers"]
    halo = halo.join(offers.select(*told).hint("merge"), "digest").select("r", "side", "at_r", "at", *told)
    rows = placed.select("r", F.lit(0).alias("side"), F.col("r").alias("at_r"), "at", *told).unionByName(halo)
    rows = rows.repartition(n, "r").sortWithinPartitions("r", "side", "at_r", "at")
    out = materialize(rows.mapInArrow(_differenced, "digest binary, asks boolean, more boolean, follows boolean, gone array<boolean>, n_shared long"))
    discard(placed)
    return out


def differences(classes: DataFrame) -> DataFrame:
    """(digest, gone, n_shared) of every class (digest, host, path, lines, marks, sizes)."""
    n = max(1, -(-classes.count() // PAGES_A_TASK))
    answers = _round(classes.withColumns({"asks": F.lit(True), "offers": F.lit(True)}), n)
    done = answers.where("asks and not more")
    more, follow = answers.where("asks and more"), answers.where("follows").select("digest")
    size = 0
    while more.limit(1).count() and size < (size := follow.count()):
        # Only copies were found: every run of copies is left with its first member, and those without an answer ask again.
        asks, out = more.select("digest", F.lit(True).alias("asks")), follow.select("digest", F.lit(False).alias("offers"))
        sequence = classes.join(asks.hint("merge"), "digest", "left").join(out.hint("merge"), "digest", "left")
        answers = _round(sequence.withColumns({"asks": F.coalesce("asks", F.lit(False)), "offers": F.coalesce("offers", F.lit(True))}).where("asks or offers"), n)
        done = done.unionByName(answers.where("asks and not more"))
        more = answers.where("asks and more")
        follow = materialize(follow.unionByName(answers.where("follows").select("digest")).distinct())
    return done.unionByName(more).select("digest", "gone", "n_shared")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines that the nearest other page has too) for every page (page_id, url, html)."""
    small_batches(pages.sparkSession)
    told = pages.select("url", "html").mapInArrow(_lines, "digest binary, host string, path string, lines binary, marks binary, sizes binary")
    first = F.min_by(F.struct("path", "lines", "marks", "sizes"), "path").alias("x")
    classes = materialize(told.groupBy("digest", "host").agg(first).select("digest", "host", "x.*"))
    found = differences(classes)
    bodies = pages.select("page_id", "url", "html").mapInArrow(_bodies, "page_id long, url string, digest binary, body array<string>")
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.filter("body", lambda x, i: ~F.col("gone")[i]))
    out = bodies.join(found.hint("merge"), "digest", "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"), "n_shared")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")

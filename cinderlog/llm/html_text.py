"""Main text of web pages, by nearest-URL page differencing.

A page is read into lines: the blocks of its text, each with the path of elements that it stands in (names, classes and ids).
Pages are paired with the page of the nearest URL path on their host, and the lines of both are aligned by their longest
common subsequence. What both share is the site's frame. A frame that changes from page to page is shared by few pairs only,
so what all pairs say of a path is put together: a path whose lines are shared more often than chance is frame on every page,
one whose lines hardly ever are is content, and such lines go or stay wherever they stand. Pairs that share most of their
text are copies of an article and tell nothing of the frame.

What differencing can't tell, HTML does: lines in elements that are never text, or that name themselves as menu, header,
footer, sidebar, notice, advert, form or readers' comments, go; lines of article and main elements stay. On a page that has
neither, lines on paths of which the pairs tell too little are held against the page of the nearest URL themselves: what both
share is deleted.

In an article only whole class names tell a frame, on elements that hold blocks; an article in a framed element (by class) is
an article all the same.

What the pairs tell is learned from all pages. Workers hold a table of at most PATHS paths, the most frequent ones. If more
paths have pairs enough to be judged, each page is joined to the verdicts on those of its own paths that the table lacks, so
that the text is the same whatever the table holds.

Edge cases: null html has no text; unclosed and stray tags are borne as browsers bear them, in time linear in the page;
pages with equal lines on one host are one page for the pairing, so that a page isn't deleted for its copy; a page alone on
its host keeps all its lines but those on frame paths; null URLs, and those without `://`, are on the host ''; rows that
repeat a key are pages each; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.bounded import frequent_and_rest
from cinderlog.llm.ordered import neighbours
from cinderlog.llm.urls import host_and_path
from cinderlog.runtime import durable, on_workers

#: HTML's element names by what they mean here, and the words of class, id and role that tell a frame.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head noscript template object svg canvas audio video select button datalist map".split())
FRAME = frozenset("nav footer aside form dialog".split())
MAIN = frozenset(("article", "main"))
SCOPE = frozenset("article main nav aside footer header section form table td th body html".split())
ITEMS = frozenset("li dt dd td th tr option".split())
FRAME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert newsletter subscribe subscription popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended comment comments commentlist disqus respond widget toolbar login signup search pagination pager complementary contentinfo header masthead topbar".split())
#: In an article: whole class names, ids or roles, of elements that hold blocks (or of inline ones).
INNER_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored promo cookie-notice newsletter share sharing share-buttons social-share related related-articles comment comments comment-list commentlist disqus_thread respond navigation complementary contentinfo".split())
HOLDERS = frozenset("div section ul ol details".split())

#: Most paths of the table that workers hold; pairs that a path needs; share of a line's characters that pairs share, by chance at most and in
#: a frame at least; share of the pages' text that a path holds above which it has to be shared by half to be frame; and
#: share of a page's text above which a pair is one of copies.
PATHS, LEAST_PAIRS, CHANCE, SHARED, BULK, COPY = 65_536, 30, 0.004, 0.008, 1 / 3, 0.5
#: Share of a page's text above which line by line differencing takes a pair for copies.
SAME = 0.8
OUTSIDE, INSIDE, NAMED = 0, 1, 2

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(?i)(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_CLOSE = {name: re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>") for name in RAW}

_steps: dict[tuple[int, str], int] = {}


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _step(parent: int, sign: str) -> int:
    """The number of a path: of its parent's number and its own element's name, classes and ids."""
    key = (parent, sign)
    if key not in _steps:
        if len(_steps) > 100_000:
            _steps.clear()
        _steps[key] = _number(parent.to_bytes(8, "little", signed=True), sign.encode("utf-8", "replace"))
    return _steps[key]


def _told(name: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool, str]:
    """Of an element: whether it is hidden, its name or its class (id, role) tells a frame, and its name with classes and ids."""
    hidden, by_class, role_main, tokens = False, False, False, []
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key in ("class", "id", "role"):
            own = value.split()
            tokens += [_DIGITS.sub("0", t) for t in own]
            role_main |= key == "role" and "main" in own
            if name not in ("body", "html") and name not in MAIN:
                if in_main:
                    by_class |= (name in HOLDERS or name in INLINE) and not INNER_WORDS.isdisjoint(own)
                else:
                    by_class |= not FRAME_WORDS.isdisjoint(_WORD.findall(value))
    return hidden, by_class, role_main, f"{name} {' '.join(sorted(tokens))}"


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, path, kind) of each block of text, in page order; kind: in an article, in a frame by name, or neither."""
    out: list[tuple[str, int, int]] = []
    # Of each open element: its name, path, whether it hides, frames by element or by class, is an article, was framed by class
    # before it.
    stack: list[tuple[str, int, bool, bool, bool, bool, int]] = []
    scopes: list[Counter] = [Counter()]
    open_: Counter = Counter()
    buffer: list[str] = []
    hidden = framed = classed = main = at = 0
    inline, depth = "", 0  # an inline frame: what it is in, and how often that is open

    def flush() -> None:
        if buffer:
            if text := " ".join("".join(buffer).split()):
                kind = NAMED if framed or classed else INSIDE if main else OUTSIDE
                out.append((text, stack[-1][1] if stack else 0, kind))
            buffer.clear()

    def pop(to: int) -> None:
        nonlocal hidden, framed, classed, main
        while len(stack) > to:
            name, _, h, f, c, m, before = stack.pop()
            hidden, framed, main = hidden - h, framed - f, main - m
            classed = before if m else classed - c
            open_[name] -= 1
            if name in SCOPE:
                scopes.pop()
            scopes[-1][name] -= 1

    while at < len(page):
        lt = page.find("<", at)
        text = page[at : lt if lt >= 0 else len(page)]
        if text and not hidden and not depth:
            buffer.append(html.unescape(text) if "&" in text else text)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = lt + 4 if page.startswith(">", lt + 4) else page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + (1 if end == lt + 4 and page[end] == ">" else 3)
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        tag = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if tag is None:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                break  # the page ends in a tag
            if not hidden and not depth:
                buffer.append("<")
            at = lt + 1
            continue
        at, name, closes = tag.end(), tag[1].lower(), page[lt + 1] == "/"
        if name in INLINE:
            if name == "br":
                buffer.append(" ")
            elif depth:
                depth += (name == inline) * (-1 if closes else 1)
            elif not closes and tag[2] and name not in VOID:
                gone, by_class, _, _ = _told(name, tag[2], main > 0)
                if gone or by_class:
                    inline, depth = name, 1
            continue
        depth = 0  # a block ends an inline frame, closed or not
        flush()
        if closes:
            if (open_ if name in SCOPE else scopes[-1])[name] > 0:
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                pop(to)
            continue
        if name in RAW:
            close = _CLOSE[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID:
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ITEMS):
            pop(len(stack) - 1)
        if tag[2].endswith("/") and name not in MAIN:
            continue
        gone, by_class, role_main, sign = _told(name, tag[2], main > 0)
        h, m = gone or name in NEVER, name in MAIN or role_main
        f = name in FRAME or name in ("header", "menu") and not main
        c = by_class and not m
        stack.append((name, _step(stack[-1][1] if stack else 0, sign), h, f, c, m, classed))
        hidden, framed, main = hidden + h, framed + f, main + m
        classed = 0 if m else classed + c
        open_[name] += 1
        scopes[-1][name] += 1
        if name in SCOPE:
            scopes.append(Counter())
    flush()
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a and each start of b, len(b) + 1 numbers; a row of the table is the bits
    of one integer."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    for x in a:
        m = where.get(x, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    zeros = 1 - np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(zeros, dtype=np.int64)))


def shared_lines(a: list, b: list, most: int = 1 << 24) -> list[int]:
    """Places in a of a longest common subsequence of a and b, ascending.

    Equal starts and ends, and lines that the other doesn't have, are set aside first. Tables of more than `most` bits are
    halved, so that memory stays linear in the lines."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    out = [*range(first)]
    in_a, in_b = set(a[first : len(a) - last]), set(b[first : len(b) - last])
    places = [i for i in range(first, len(a) - last) if a[i] in in_b]
    rest, other = [a[i] for i in places], [x for x in b[first : len(b) - last] if x in in_a]
    out += [places[i] for i in _traced(rest, other, most)]
    return out + [*range(len(a) - last, len(a))]


def _traced(a: list, b: list, most: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > most and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[:half - 1 : -1], b[::-1])[::-1]).argmax())
        return _traced(a[:half], b[:cut], most) + [half + i for i in _traced(a[half:], b[cut:], most)]
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    rows, full = [(1 << len(b)) - 1], (1 << len(b)) - 1
    for x in a:
        v, m = rows[-1], where.get(x, 0)
        rows.append(((v + (v & m)) | (v & ~m)) & full)
    # A 0 in row i, bit j: the subsequence of a[:i] and b[:j+1] is longer than that of a[:i] and b[:j].
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's lines without their texts: a number of path and text each, the path's number, and the text's length."""
    for x in batches:
        parsed = [lines(p or "") for p in x.column(2).to_pylist()]
        number = lambda text, path: _number(path.to_bytes(8, "little", signed=True), text.encode("utf-8", "replace"))
        flat = [[(number(t, p), p, len(t)) for t, p, _ in one] for one in parsed]
        column = lambda k, kind: pa.array([[v[k] for v in one] for one in flat], pa.list_(kind))
        digest = pa.array([hashlib.md5(np.array([v[0] for v in one], np.int64).tobytes()).digest() for one in flat], pa.binary())
        bare = pa.array([all(k != INSIDE for _, _, k in one) for one in parsed], pa.bool_())
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), digest, column(0, pa.int64()), column(1, pa.int64()), column(2, pa.int32()), bare, x.column(3)], ["host", "path", "digest", "lines", "paths", "sizes", "bare", "whole"])


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pairs say of each path: pages, the shares of its characters that are shared (in millionths) and their squares,
    its characters and those of the pages."""
    for x in batches:
        total: dict[int, list[int]] = {}
        for own, paths, sizes, other, other_sizes in zip(*(x.column(k).to_pylist() for k in range(5)), strict=True):
            gone = shared_lines(own, other)
            page, shared = sum(sizes), sum(sizes[i] for i in gone)
            if shared > COPY * min(page, sum(other_sizes)):
                continue
            both: dict[int, list[int]] = {}
            for p, n in zip(paths, sizes, strict=True):
                both.setdefault(p, [0, 0])[0] += n
            for i in gone:
                both[paths[i]][1] += sizes[i]
            for p, (n, m) in both.items():
                share = round(1e6 * m / n)
                sums = total.setdefault(p, [0] * 5)
                for k, v in enumerate((1, share, share * share // 10**6, n, page)):
                    sums[k] += v
        columns = [pa.array(total.keys(), pa.int64()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in range(5))]
        yield pa.RecordBatch.from_arrays(columns, ["p", "n", "u", "uu", "size", "page"])


def judged(n: int, u: int, uu: int, size: int, page: int) -> bool | None:
    """Whether a path is frame, by the sums of `_evidence`; None if they don't tell."""
    if n < LEAST_PAIRS:
        return None
    mean = u / n / 1e6
    error = 2 * (max(uu / n / 1e6 - mean * mean, 0) / n) ** 0.5
    if mean >= 0.5 or mean - error > CHANCE and size <= BULK * page:
        return True
    return False if mean + error + 3 / n < SHARED else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`judged` of each path; without those that nothing is told of."""
    for x in batches:
        told = [(r[0], v) for r in zip(*(x.column(k).to_pylist() for k in range(6)), strict=True) if (v := judged(*r[1:])) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in told], pa.int64()), pa.array([v for _, v in told], pa.bool_())], ["p", "frame"])


def frame_paths(pages: DataFrame, url: str, page: str) -> tuple[dict[int, bool], DataFrame | None, bool]:
    """Of paths: whether they are frame, for PATHS paths at most, which reach the driver; (whole, verdicts), the same of each
    page's other paths, None if there are none; and whether any page has no article."""
    host, path = host_and_path(F.col(url))
    outline = pages.select(host.alias("host"), path.alias("path"), F.col(page).alias("h"), _whole(page).alias("whole")).mapInArrow(_outline, "host string, path string, digest binary, lines array<long>, paths array<long>, sizes array<int>, bare boolean, whole binary")
    outline = durable(outline, "outline")
    pairs = partners(outline.groupBy("host", "digest").agg(F.min("path").alias("path")), "paths").where(F.col("partner").isNotNull())
    one = outline.groupBy("host", "digest").agg(*(F.first(c).alias(c) for c in ("lines", "paths", "sizes")))
    one = durable(one, "pages")
    other = one.select(F.col("host").alias("o_host"), F.col("digest").alias("partner"), F.col("lines").alias("o_lines"), F.col("sizes").alias("o_sizes"))
    both = pairs.join(one, ["host", "digest"]).join(other, (F.col("host") == F.col("o_host")) & (pairs["partner"] == other["partner"]))
    told = both.select("lines", "paths", "sizes", "o_lines", "o_sizes").mapInArrow(_evidence, "p long, n long, u long, uu long, size long, page long")
    sums = told.groupBy("p").agg(*(F.sum(c).alias(c) for c in ("n", "u", "uu", "size", "page")))
    most, rest = frequent_and_rest(sums.where(F.col("n") >= LEAST_PAIRS), "n", PATHS, "path-sums")
    verdicts = ((r.p, judged(r.n, r.u, r.uu, r.size, r.page)) for r in most.collect())
    frame = {p: v for p, v in verdicts if v is not None}
    return frame, None if rest is None else rest_of_paths(outline, most, rest), not outline.where("bare").isEmpty()


def rest_of_paths(outline: DataFrame, most: DataFrame, rest: DataFrame) -> DataFrame:
    """(whole, verdicts): of each page, by its digest, a map of those of its paths that are judged and not among `most`."""
    told = rest.select("p", "n", "u", "uu", "size", "page").mapInArrow(_judge, "p long, frame boolean")
    own = outline.select("whole", F.explode(F.array_distinct("paths")).alias("p")).join(F.broadcast(most.select("p")), "p", "left_anti").distinct()
    each = own.join(told, "p").groupBy("whole").agg(F.map_from_entries(F.collect_list(F.struct("p", "frame"))).alias("verdicts"))
    return durable(each, "page-verdicts")


def partners(pages: DataFrame, name: str) -> DataFrame:
    """(host, digest, partner): to each page (host, path, digest) the digest of the one with the nearest URL path on its host,
    null if it is alone."""
    near = neighbours(pages.select("host", "path", "digest"), ["host", "path", "digest"], name)
    start = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), _common_start(F.col(f"{side}.path"), F.col("path")))
    prior, following = F.coalesce(start("prior"), F.lit(-1)), F.coalesce(start("following"), F.lit(-1))
    partner = F.when(F.greatest(prior, following) >= 0, F.when(prior >= following, F.col("prior.digest")).otherwise(F.col("following.digest")))
    return near.select("host", "digest", partner.alias("partner"))


def kept_lines(page: str, frame: Mapping[int, bool], names: bool = True) -> tuple[list[str], list[bool] | None]:
    """The lines of a page that stay, and, if it has no article, which of them are on paths that nothing tells of.

    names: whether HTML's own names count; if not, the path table alone decides."""
    parsed = lines(page)
    if not names:
        return [t for t, p, _ in parsed if not frame.get(p, False)], None
    left = [(t, p, k) for t, p, k in parsed if k != NAMED and not frame.get(p, False)]
    if any(k == INSIDE for _, _, k in parsed):
        return [t for t, p, k in left if k == INSIDE or frame.get(p) is False], None
    return [t for t, _, _ in left], [p not in frame for _, p, _ in left]


def _parse(shared, names: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rest = x.column(3).to_pylist()
            frames = [ChainMap(dict(own), shared.value) if own else shared.value for own in rest]
            parsed = [kept_lines(p or "", frame, names) for p, frame in zip(x.column(2).to_pylist(), frames, strict=True)]
            text = ["\n".join(t) if free is None or not any(free) else None for t, free in parsed]
            rest = [t if done is None else [] for done, (t, _) in zip(text, parsed, strict=True)]
            free = [f if done is None else [] for done, (_, f) in zip(text, parsed, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(text, pa.string()), pa.array(rest, pa.list_(pa.string())), pa.array(free, pa.list_(pa.bool_()))], ["k", "u", "text", "blocks", "free"])

    return parse


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        text = []
        for own, free, other in zip(*(x.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            gone = set(shared_lines(own, other or []))
            size = lambda some: sum(map(len, some))
            if size(own[i] for i in gone) > SAME * max(size(own), size(other or [])):
                gone = set()
            text.append("\n".join(line for i, line in enumerate(own) if i not in gone or not free[i]))
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(text, pa.string())], ["g_host", "g_digest", "left"])


def _whole(page: str) -> Column:
    """16 bytes that tell whole pages apart."""
    return F.unhex(F.md5(page))


def _digest(*columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def _common_start(a: Column, b: Column) -> Column:
    """Characters that two strings begin with alike."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", names: bool = True) -> DataFrame:
    """(key, url, text) of every row."""
    spark = pages.sparkSession
    on_workers(spark)
    frame, rest, some_bare = frame_paths(pages, url, page)
    shared = spark.sparkContext.broadcast(frame)
    kind = dict(pages.select(F.col(key).alias("k"), F.col(url).alias("u")).dtypes)
    whole = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("h"), _whole(page).alias("whole"))
    if rest is None:
        whole = whole.withColumn("verdicts", F.lit(None).cast("map<bigint,boolean>"))
    else:
        whole = whole.join(rest.hint("merge"), "whole", "left")
    read = whole.select("k", "u", "h", "verdicts").mapInArrow(_parse(shared, names), f"k {kind['k']}, u {kind['u']}, text string, blocks array<string>, free array<boolean>")
    if rest is not None and some_bare and names:
        read = durable(read, "read")  # else the join would move all pages twice
    plain = read.where(F.col("text").isNotNull()).select("k", "u", "text")
    if not (some_bare and names):
        return plain.select(F.col("k").alias(key), F.col("u").alias(url), "text")

    host, path = host_and_path(F.col("u"))
    bare = durable(read.where(F.col("text").isNull()).select("k", "u", host.alias("host"), path.alias("path"), _digest("blocks", "free").alias("digest"), "blocks", "free"), "bare")
    pairs = partners(bare.groupBy("host", "digest").agg(F.min("path").alias("path")), "bare-paths")
    one = bare.groupBy("host", "digest").agg(F.first("blocks").alias("blocks"), F.first("free").alias("free"))
    other = one.select(F.col("host").alias("o_host"), F.col("digest").alias("o_digest"), F.col("blocks").alias("o_blocks"))
    both = pairs.join(one, ["host", "digest"]).join(other, (F.col("host") == F.col("o_host")) & (F.col("partner") == F.col("o_digest")), "left")
    left = both.select("host", "digest", "blocks", "free", "o_blocks").mapInArrow(_difference, "g_host string, g_digest string, left string")
    differenced = bare.join(left, (F.col("host") == F.col("g_host")) & (F.col("digest") == F.col("g_digest"))).select("k", "u", F.col("left").alias("text"))
    return plain.union(differenced).select(F.col("k").alias(key), F.col("u").alias(url), "text")

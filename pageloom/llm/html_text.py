"""Main text of web pages: nearest-URL page differencing, with mark-up landmarks as a veto.

A page is read into lines, one a block. Pages of a host are ordered by URL path; each is paired with
the ``PARTNERS`` nearest before it and after it that are no copies of it or of one another, the lines
of each pair are aligned by a longest common subsequence, and what a page shares with a partner is
deleted. A partner that holds half or more of the text of a page's long lines (five words and more) is
a copy and is passed over, however many there are up to ``REACH`` places away; pages of a host with
equal lines are one place, at the least of their paths.

Landmarks decide where differencing can't. Lines inside an article or main element are not deleted,
as articles of one host share paragraphs. Lines that differ from page to page and yet are no article
are known by their mark-up: menus, headers, footers, sidebars, notices, adverts, forms, comments. A
text block inside an article whose class names such a part ("share", "note-alert") is in doubt and left
to differencing, as are all lines of pages without an article element, but for runs of three and more
blocks that are nothing but links (menus) and copyright notices.

Equal lines of a host are merged before pages are ordered by a range partitioning, and each place of
the order goes to the bucket of its rank, and to the next one if it lies within ``REACH`` of it; so
hot hosts and groups of copies are spread over tasks. Pages are read once for the hashes of their
lines, which is all that is ordered and compared, and once for their texts, which are shuffled once,
compressed, to meet their deletions.

Defined results: null html counts as empty and gives an empty text; a null url has an empty host
and path; truncated or badly nested mark-up is read as far as it goes; a page that would lose all its
lines loses none; repeated rows get equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cut, hot_join

#: Zones of lines: never text, undecided, of an article, of an article but in doubt, of a form.
SKIP, OPEN, MAIN, DOUBT, FORM = range(5)
#: Partners on each side, places on each side among which they are sought, and places of a bucket.
PARTNERS, REACH, BUCKET = 8, 64, 2048
#: A line of so many words counts when copies are told by their text; the share that makes a copy.
LONG, COPY = 5, 0.5
#: Blocks of nothing but links that make a menu.
MENU = 3
#: Element names by role in HTML, and class words by which pages name such parts.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select"}
NEVER = {"head", "nav", "footer", "aside", "button", "dialog", "menu", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Blocks that hold text of their own; others group them.
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption", "caption", "li", "dt", "dd", "td", "th", "tr", "table"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
ADVERTS = {"ad", "ads", "adbox", "adslot", "advert", "advertisement", "advertising", "adverts", "promo", "sponsor", "sponsored"}
COMMENTS = {"comment", "comments", "commentlist", "reply", "replies"}
PARTS = ADVERTS | COMMENTS | {
    "alert", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus", "footer", "gdpr", "login", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promotion", "recommended",
    "related", "respond", "responses", "share", "sharing", "sidebar", "signup", "social", "subscribe", "subscription", "toolbar", "topbar", "widget",
}
#: First words by which a class speaks about a part that is elsewhere ("has-sidebar").
HEDGES = {"has", "have", "with", "no", "not", "non", "without", "hide", "hides", "show", "shows"}

#: Possessive, so that a tag that never ends costs one pass over it.
_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+)>|<[!?][^>]*>""")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)")
_RIGHTS = re.compile(r"(?:copyright\s*)?(?:©|\(c\)\s)|copyright\s+[0-9]{4}", re.I)


def _part_words(value: str) -> set[str]:
    """The part words of a class or id whose tokens don't speak about a part elsewhere."""
    out: set[str] = set()
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if words and words[0] not in HEDGES:
            out |= PARTS.intersection(words)
    return out


def _zone(name: str, attrs: str, zone: int) -> int:
    """The zone inside an element, given the zone around it."""
    article = name in ("article", "main")
    if zone == SKIP or (zone == FORM and not article and name not in NEVER):
        return zone
    if name in NEVER or (name == "header" and zone not in (MAIN, DOUBT)):
        return SKIP
    if name == "form":
        return FORM
    inside, words, main = zone in (MAIN, DOUBT), set(), article
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in ROLES):
            return SKIP
        main |= key == "role" and value.lower() == "main"
        if key in ("class", "id") and name not in ("body", "html", "main"):
            words |= _part_words(value)
    if article:  # an article is what its name says, but for comments and adverts that are marked up as articles
        words &= (ADVERTS | COMMENTS) if inside else set()
    if words & ADVERTS or (words and name in BLOCKS and name not in TEXTS):
        return SKIP
    if words and name in TEXTS and zone == MAIN:
        return DOUBT
    return MAIN if main and zone != DOUBT else zone


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of every block that has text, in page order."""
    out: list[tuple[str, int]] = []
    links: list[bool] = []  # whether a line is nothing but links
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at, low, anchors, bare = OPEN, 0, None, 0, False

    def flush() -> None:
        nonlocal bare
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, zone))
                links.append(not bare)
            parts.clear()
        bare = False

    while m := _TAG.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            bare = bare or (not anchors and not piece.isspace())
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            if name == "svg" and m[3].endswith("/"):
                continue
            low = low or page.lower()
            end = low.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            continue
        if name in BLOCKS:
            flush()
            anchors = 0
        if name == "a":
            anchors = 0 if m[1] else 1
        if name in VOID:
            parts.append(" ")
        elif m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(z != zone for _, z in stack[k:]) or stack[k][1] != zone:
                        flush()
                    zone = stack[k][1]
                    del stack[k:]
                    break
        elif not m[3].endswith("/") or name in BLOCKS:
            if name in BLOCKS and stack and stack[-1][0] == "p":
                zone = stack.pop()[1]
            before, inner = zone, _zone(name, m[3], zone)
            if inner != zone:
                flush()
                zone = inner
            if name in BLOCKS or zone != before:
                stack.append((name, before))
    rest = page[at:]
    if "<" in rest and re.match(r"<[/!a-zA-Z]", rest[rest.rfind("<") :]):
        rest = rest[: rest.rfind("<")]
    if rest:
        parts.append(rest)
        bare = bare or (not anchors and not rest.isspace())
    flush()
    return _settled(out, links)


def _settled(lines: list[tuple[str, int]], links: list[bool]) -> list[tuple[str, int]]:
    """Menus and copyright notices among open lines are skipped; a form's lines are open if nothing else is text."""
    zones = [z for _, z in lines]
    if not {OPEN, MAIN, DOUBT} & set(zones):
        zones = [OPEN if z == FORM else z for z in zones]
    if MAIN not in zones:
        k = 0
        while k < len(zones):
            end = k
            while end < len(zones) and zones[end] == OPEN and links[end]:
                end += 1
            if end - k >= MENU:
                zones[k:end] = [SKIP] * (end - k)
            if end == k and zones[k] == OPEN and _RIGHTS.match(lines[k][0]):
                zones[k] = SKIP
            k = max(end, k + 1)
    return [(t, SKIP if z == FORM else z) for (t, _), z in zip(lines, zones, strict=True)]


def line_hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 31 | zlib.adler32(raw) & 0x7FFFFFFF) & 0x7FFFFFFFFFFFFFFF


def _lcs_row(a: list[int], b: list[int]) -> tuple[list[int], int]:
    """Bit rows of the longest common subsequence of a's prefixes with b: a zero bit is a step."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    return rows, v


def _steps(v: int, n: int) -> np.ndarray:
    """Lengths for b's prefixes of 0 to n items from a bit row."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common(a: list[int], b: list[int], most: int = 1 << 28) -> list[int]:
    """Indexes in ``a`` of one longest common subsequence with ``b``; memory is bounded by ``most`` bits."""
    if not a or not b:
        return []
    if len(a) * len(b) <= most or len(a) == 1:
        rows, _ = _lcs_row(a, b)
        out, i, j = [], len(a) - 1, len(b) - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:  # no step here: b[j] is not needed
                j -= 1
            elif i and not rows[i - 1] >> j & 1:  # the step was there before a[i]
                i -= 1
            else:
                out.append(i)
                i, j = i - 1, j - 1
        return out[::-1]
    half = len(a) // 2
    left = _steps(_lcs_row(a[:half], b)[1], len(b))
    right = _steps(_lcs_row(a[half:][::-1], b[::-1])[1], len(b))[::-1]
    split = int(np.argmax(left + right))
    return common(a[:half], b[:split], most) + [half + i for i in common(a[half:], b[split:], most)]


def _is_copy(shared: int, a: int, b: int) -> bool:
    """Whether two pages of a and b characters in long lines, ``shared`` of them in common, are copies in part."""
    return min(a, b) > 0 and shared >= COPY * min(a, b)


def differences(pages: list[tuple[str, list[int], list[int]]], partners: int = PARTNERS) -> list[set[int]]:
    """For pages (host, lines, characters of long lines) in URL order: indexes of lines shared with partners."""
    gone: list[set[int]] = [set() for _ in pages]
    total, held = [sum(sizes) for _, _, sizes in pages], [set(lines) for _, lines, _ in pages]
    for order in (range(len(pages)), range(len(pages) - 1, -1, -1)):
        past: list[int] = []  # nearest last; no two are copies
        for r in order:
            host, lines, sizes = pages[r]
            if past and pages[past[-1]][0] != host:
                past = []
            for p in past[:]:
                if held[r].isdisjoint(held[p]):
                    continue
                both = common(lines, pages[p][1])
                if _is_copy(sum(sizes[i] for i in both), total[r], total[p]):
                    past.remove(p)  # this page stands for it from here on
                else:
                    gone[r].update(both)
            past = [*past, r][-partners:]
    return gone


def deletions(zones: list[int], gone: set[int]) -> set[int]:
    """Which of the shared lines are deleted: none of an article, and not all that the page has."""
    out = {i for i in gone if zones[i] != MAIN}
    left = [i for i, z in enumerate(zones) if z != SKIP]
    return out if not left or any(i not in out for i in left) else {i for i in out if zones[i] == SKIP}


def text_of(lines: list[tuple[str, int]], gone: set[int] = frozenset()) -> str:
    """The text that is left: of an article if there is one, else of all that is open."""
    zones = [z for _, z in lines]
    wanted, lost = ((MAIN, DOUBT) if MAIN in zones else (OPEN, DOUBT)), deletions(zones, gone)
    return "\n".join(t for i, (t, z) in enumerate(lines) if z in wanted and i not in lost)


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2]) if m else ("", "")


def _read(pages: DataFrame, texts: bool) -> DataFrame:
    """(host, path, lines, sizes, one, two) of each page; or, with its texts, (page_id, url, host, one, two, kept).

    ``sizes`` has the characters of long lines; ``one`` and ``two`` tell the lines of pages apart by 128 bits;
    ``kept`` is the zone and text of each line, compressed, skipped lines without their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [host_and_path(u.as_py()) for u in batch.column("url")]
            read = [page_lines(h.as_py() or "") for h in batch.column("html")]
            lines = pa.array([[line_hash(t) for t, _ in r] for r in read], pa.list_(pa.int64()))
            host = pa.array([p[0] for p in places], pa.string())
            if texts:
                kept = [zlib.compress("\n".join(f"{z}{t if z != SKIP else ''}" for t, z in r).encode("utf-8", "surrogatepass"), 1) for r in read]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), host, lines, pa.array(kept, pa.binary())], names=["page_id", "url", "host", "lines", "kept"])
            else:
                sizes = [[len(t) if t.count(" ") >= LONG - 1 else 0 for t, _ in r] for r in read]
                yield pa.RecordBatch.from_arrays([host, pa.array([p[1] for p in places], pa.string()), lines, pa.array(sizes, pa.list_(pa.int32()))], names=["host", "path", "lines", "sizes"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = rows.mapInArrow(run, "page_id long, url string, host string, lines array<long>, kept binary" if texts else "host string, path string, lines array<long>, sizes array<int>")
    found = found.withColumns({"one": F.xxhash64("lines"), "two": F.xxhash64(F.lit(1), "lines")})
    return found.drop("lines") if texts else found


def _bucketed(places: DataFrame, reach: int, bucket: int) -> DataFrame:
    """``places`` with rank and bucket in the order of URLs; within ``reach`` of a bucket's ends a place is in both."""
    order = ["host", "path", "one", "two"]
    ordered = cut(places.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.select("*", F.spark_partition_id().alias("part"), place.alias("place"))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = ordered.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sizes, before, strict=False)], "part int, before long")
    ranked = placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("place"))
    near = F.array_distinct(F.array(*[F.expr(f"greatest(rank + {d}, 0) div {bucket}") for d in (-reach, 0, reach)]))
    return ranked.withColumn("bucket", F.explode(near)).withColumn("own", F.expr(f"rank div {bucket} = bucket"))


def shared_lines(places: DataFrame, partners: int = PARTNERS, reach: int = REACH, bucket: int = BUCKET) -> DataFrame:
    """``places`` (host, path, one, two, n, lines, sizes) -> (host, one, two, n, gone) of those that share lines with partners."""

    def emit(rows: list[dict]) -> pa.RecordBatch:
        gone = differences([(r["host"], r["lines"], r["sizes"]) for r in rows], partners)
        out = [(r["host"], r["one"], r["two"], r["n"], sorted(g)) for r, g in zip(rows, gone, strict=True) if r["own"] and g]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "one", "two", "n", "gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["bucket"] != row["bucket"]:
                    yield emit(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield emit(rows)

    dealt = _bucketed(places, reach, bucket).select("bucket", "rank", "own", "host", "one", "two", "n", "lines", "sizes")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "rank").mapInArrow(run, "host string, one long, two long, n long, gone array<int>")


def extract(pages: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """``pages`` (page_id, url, html) -> (page_id, url, text, n_deleted: lines that differencing deleted)."""
    read = cut(_read(pages, texts=False))
    bodies = read.where("size(lines) > 0").groupBy("host", "one", "two").agg(F.min("path").alias("path"), F.count("*").alias("n"), F.min("lines").alias("lines"), F.min("sizes").alias("sizes"))
    gone = cut(shared_lines(bodies, partners))
    joined = hot_join(_read(pages, texts=True), gone, ["host", "one", "two"], read.count(), spread=("page_id", "url"), how="left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = [], []
            for raw, gone in zip(batch.column("kept"), batch.column("gone"), strict=True):
                lines = [(x[1:], int(x[0])) for x in zlib.decompress(raw.as_py()).decode("utf-8", "surrogatepass").split("\n") if x]
                gone = set(gone.as_py() or ())
                texts.append(text_of(lines, gone))
                lost.append(len(deletions([z for _, z in lines], gone)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(lost, pa.int64())], names=["page_id", "url", "text", "n_deleted"])

    return joined.select("page_id", "url", "kept", "gone").mapInArrow(run, "page_id long, url string, text string, n_deleted long")


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_deleted)."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted")

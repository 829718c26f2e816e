"""Main text of web pages: markup that says what it is, and nearest-URL page differencing for the rest.

A tolerant scanner turns a page into lines (blocks of text, white space folded). Lines inside elements
that are menus, headers, footers, sidebars, notices, adverts, forms or comments by their tag, class, id or role are
left out; if the page has an article (or else a main element), so are the lines outside it. Elements inside an article whose class only hints at that
(share, related, legal, hidden and the like: HINTS) are not judged by it.

Then pages are ordered by host and URL path. Each is paired with the page of the same host whose path is
nearest, the two sequences of lines are aligned by longest common subsequence, and lines that both share
are deleted: all shared lines of a page without an article or main element, and in articles the shared lines of elements with such hints.
Other lines of an article stay (an article republished under a neighbouring URL is not boilerplate). A copy is no such pair: if one of the two would keep none
of its lines, the next nearest page is taken, however far it is. Pages that are copies of all others of their host keep their lines.

Rules: a null page is empty and gives an empty text. Pages without a host form a host of their own. Repeated rows
(same URL and page) are never compared with each other and give repeated results. Unclosed elements end with
their parent, an unclosed comment at its next ``>``. Pages of any length are taken whole.

Ordering is a range partitioning by (host, path), so that a host with a third of all pages is split; ranks follow from
counts of the partitions. Neighbours of the same loose lines are one block. Runs of RUN pages (with REACH pages of context at either end) are aligned
together; pages for which that isn't enough are taken again with the first and the last page of ever more blocks, until none is left.
"""

from __future__ import annotations

import bisect
import functools
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, pick, settled, shuffle_partitions

RUN, REACH = 64, 2

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset("head nav footer aside form noscript template button select option datalist label input svg math canvas object audio video menu dialog map".split())
CLOSED_BY_BLOCK = frozenset(["p"])
HEADS = frozenset("head nav header ul ol li p".split())
SELF_NESTING = {"li": ("ul", "ol", "menu"), "option": ("select", "datalist"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}
SAID = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement adsense adslot sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login comment comments disqus reply replies respond pagination pager searchform".split()
)
HINTS = frozenset("alert popup modal overlay share sharing social related recommended widget toolbar skip search legal copyright hidden".split())
REMARKS = frozenset("comment comments disqus reply replies respond".split())
MODIFIERS = frozenset("no has with without is not hide show fixed open closed sticky enabled disabled active".split())
CONTAINERS = frozenset("list item items link links bar box left right slot container wrapper section area block inner top bottom main primary secondary unit content thread body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TAGS = r"<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?"
#: Tokens of the rest of a page, by whether a comment and a CDATA section can still end in it: what has no end is not looked for again and again.
_TOKENS = {(c, d): re.compile((r"<!--.*?-->|" if c else "") + r"<!--[^>]*>?|" + (r"<!\[CDATA\[.*?\]\]>|" if d else "") + _TAGS, re.S) for c in (False, True) for d in (False, True)}
_UNENDED = re.compile("<[!?/]")
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[^a-z0-9]+")


#: How an element is left out: not at all; unless it holds most of the main text; unless it holds most of what stands in articles; always.
KEEP, SOFT, COMMENTS, HARD = range(4)


def named(value: str, inside: bool) -> int:
    """Whether a class or id names a region that is no main text: a name that ends in such a word, perhaps with a word for a container behind it. Names that only say how a page is laid
    out (no-sidebar, header-fixed, share-page) don't."""
    found = KEEP
    for token in value.split():
        parts = [x for x in _PART.split(token) if x]
        if not parts or not MODIFIERS.isdisjoint(parts):
            continue
        while len(parts) > 1 and (parts[-1] in CONTAINERS or parts[-1].isdigit()):
            parts.pop()
        word = parts[-1]
        if inside and (word in HINTS or word == "header"):
            continue
        if word in SAID or word in HINTS:
            found = max(found, COMMENTS if word in REMARKS else SOFT)
    return found


def left_out(tag: str, attrs: str, inside: bool) -> int:
    """How far an element is left out for holding no main text. inside: an article is open around it."""
    if tag == "form":
        return SOFT
    if tag in LEFT_OUT or tag == "header" and not inside:
        return HARD
    if not attrs or tag in ("body", "html", "article", "main") and "comment" not in attrs.lower():
        return KEEP
    found = KEEP
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if not inside and (name == "hidden" or name == "aria-hidden" and value == "true") or name == "role" and value in ROLES:
            found = max(found, SOFT)
        elif name in ("class", "id"):
            found = max(found, named(value, inside))
    return found


def hinted(attrs: str) -> bool:
    """Whether the class or id of an element inside an article hints at something else, without saying it."""
    return any(name.lower() in ("class", "id") and HINTS & set(_PART.split(value.strip("\"'").lower())) for name, value in _ATTR.findall(attrs))


#: Where a line stands: left out by its element, in an article, in a main element, elsewhere; in an article or main element under a hint.
OUT, ARTICLE, MAIN, BODY, ARTICLE_HINT, MAIN_HINT = range(6)
UNDER = {ARTICLE: ARTICLE_HINT, MAIN: MAIN_HINT}


def lines_of(page: str) -> list[tuple[str, int]]:
    """The lines of a page with where they stand."""
    out: list[tuple[str, int, tuple]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, tuple]] = []  # tag, left out, where its text stands, the elements around it that leave it out (number, how far)
    count = 0
    n, at = len(page), 0
    last_tag, last_comment, last_cdata = page.rfind(">"), page.rfind("-->"), page.rfind("]]>")
    open_tags: dict[str, int] = {}  # so that the stack is only searched for what is on it
    bad_heads = 0

    def where() -> tuple[int, tuple]:
        return stack[-1][2:] if stack else (BODY, ())

    def close_line() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                out.append((line, *place[0]))
            parts.clear()

    def pop_to(i: int) -> None:
        nonlocal bad_heads
        if any(x[0] in BLOCK for x in stack[i:]):
            close_line()
        for t, bad, *_ in stack[i:]:
            open_tags[t] -= 1
            bad_heads -= bad and t in HEADS
        del stack[i:]

    place = [(BODY, ())]

    def text(s: str) -> None:
        if s:
            now = where()
            if now != place[0]:
                close_line()
                place[0] = now
            parts.append(s)

    while at < n:
        if at > last_tag:  # no tag can end any more
            end = _UNENDED.search(page, at)
            text(page[at : end.start() if end else n])
            break
        m = _TOKENS[at <= last_comment, at <= last_cdata].search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:-3], quote=False))
            continue
        tag, closing, attrs = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if closing:
            if open_tags.get(tag):
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag in BLOCK:
                close_line()
            continue
        if tag in BLOCK:
            close_line()
            if stack and stack[-1][0] in CLOSED_BY_BLOCK or any(x[0] == "p" for x in stack[-3:]) and tag != "br":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        if tag != "br":
                            pop_to(i)
                        break
            if tag in SELF_NESTING and open_tags.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
                    if stack[i][0] in SELF_NESTING[tag]:
                        break
            if bad_heads and tag in ("body", "article", "main"):  # a head, menu or header that was never closed ends here
                for i, (t, bad, *_) in enumerate(stack):
                    if bad and t in HEADS:
                        pop_to(i)
                        break
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        above, around = where()
        inside = above in (ARTICLE, MAIN, ARTICLE_HINT, MAIN_HINT)
        if how := left_out(tag, attrs, inside):
            count += 1
            if len(around) < 32 and not any(h == HARD for _, h in around[-1:]):  # what is left out always stays so; what is nested deeper goes with those around it
                around = (*around, (count, how))
        bad = bool(around)
        place_ = ARTICLE if tag == "article" else above if inside else MAIN if tag == "main" else BODY
        if place_ in UNDER and inside and hinted(attrs):
            place_ = UNDER[place_]
        stack.append((tag, bad, place_, around))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        bad_heads += bad and tag in HEADS
    close_line()
    return placed(out)


def placed(lines: list[tuple[str, int, tuple]]) -> list[tuple[str, int]]:
    """The lines, OUT where an element around them is left out. An element that holds half of the text of all articles isn't, or, on a page without any, half of the text that no
    menu, footer or the like holds, unless it says that it holds comments. Inner elements are judged first."""
    free = [all(h != HARD for _, h in around) for _, _, around in lines]
    story = [ok and place not in (BODY, OUT) and all(h != COMMENTS for _, h in around) for ok, (_, place, around) in zip(free, lines)]
    counts = story if any(story) else free
    whole = sum(len(x[0]) for x, c in zip(lines, counts) if c)
    within: dict[int, list[int]] = {}
    level: dict[int, int] = {}
    for i, (_, _, around) in enumerate(lines):
        if free[i]:
            for number, how in around:
                within.setdefault(number, []).append(i)
                level[number] = how
    judged = [[x for x, _ in around] if ok else [0] for ok, (_, _, around) in zip(free, lines)]  # what still leaves a line out
    for number in sorted(within, reverse=True):
        if level[number] == COMMENTS and counts is free:
            continue
        own = sum(len(lines[i][0]) for i in within[number] if counts[i] and judged[i][-1] == number)
        if own and 2 * own >= whole:
            for i in within[number]:
                if judged[i][-1] == number:
                    judged[i].pop()
    return [(text, OUT if left else place) for (text, place, _), left in zip(lines, judged)]


def kept_lines(lines: list[tuple[str, int]]) -> list[bool]:
    """What the markup keeps: the lines of articles, or of the main element, or what isn't left out."""
    for best in ((ARTICLE, ARTICLE_HINT), (MAIN, MAIN_HINT)):
        if any(w in best for _, w in lines):
            return [w in best for _, w in lines]
    return [w != OUT for _, w in lines]


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence, by chains of ever smaller ends (Hunt and Szymanski)."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a -= 1
        end_b -= 1
    spots: dict[int, list[int]] = {}
    for j in range(end_b - 1, start - 1, -1):
        spots.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chain: list[tuple | None] = []
    for i in range(start, end_a):
        for j in spots.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, j, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            elif j < ends[k]:
                ends[k], chain[k] = j, link
    middle, link = [], chain[-1] if chain else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [(i, i) for i in range(start)] + middle[::-1] + [(end_a + i, end_b + i) for i in range(len(a) - end_a)]


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").removeprefix("www."), re.sub(r"(?:index)?\.html?$|/+$", "", u.path) + (f"?{u.query}" if u.query else "")
    except ValueError:
        return "", url or ""


def _outline(batch: pa.RecordBatch) -> pa.RecordBatch:
    hosts, paths, hashes, kept, loose, same = [], [], [], [], [], []
    for url, page, ph in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), batch.column("ph").to_pylist()):
        h, p = host_and_path(url)
        lines = lines_of(page or "")
        keep = kept_lines(lines)
        hosts.append(h)
        paths.append(p)
        hashes.append([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, _ in lines])
        kept.append([i for i, k in enumerate(keep) if k])
        # a page with an article keeps that alone: there only lines under a hint can go, elsewhere all
        loose.append([i for i in kept[-1] if lines[i][1] not in (ARTICLE, MAIN)])
        same.append(xxhash.xxh3_64_intdigest(np.array([hashes[-1][i] for i in kept[-1]], np.int64).tobytes()) - (1 << 63) if loose[-1] else ph)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("page_id"), batch.column("ph"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int32())),
            pa.array(loose, pa.list_(pa.int32())), pa.array(same, pa.int64()),
        ],
        ["page_id", "ph", "host", "path", "lines", "kept", "loose", "same"],
    )


def _shared_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _compare(group: pa.Table) -> pa.Table:
    """A run of neighbouring pages: for each of its pages that are asked for the loose lines to delete, how many lines are shared, and whether its pair lies
    beyond the blocks at hand."""
    rows = group.to_pylist()
    firsts, lasts = {}, {}
    for r in sorted((r for r in rows if r["tip"]), key=lambda r: r["rank"]):
        firsts.setdefault(r["block"], r)
        lasts[r["block"]] = r
    out = []
    for r in rows:
        if not r["asked"] or not r["lines"]:
            continue
        near = {-1: r["block"], 1: r["block"]}
        while True:
            sides = []
            for step, found in ((-1, lasts), (1, firsts)):
                block = near[step] + step
                if block in found:
                    if found[block]["host"] == r["host"]:
                        sides.append((_shared_prefix(found[block]["path"], r["path"]), -step, found[block]))
                elif 0 <= block < r["blocks"]:
                    sides = None
                    break
            if not sides:
                if sides is None:
                    out.append((r["rank"], r["page_id"], r["ph"], [], 0, True))
                break
            best = max(x[0] for x in sides)
            pairs = []
            for prefix, back, other in sides:
                if prefix < best or pairs and not r["loose"]:
                    continue
                common = common_lines(r["lines"], other["lines"])
                shared, theirs = {a for a, _ in common}, {b for _, b in common}
                if r["loose"] and (shared.issuperset(r["kept"]) or other["kept"] and theirs.issuperset(other["kept"])):
                    near[-back] -= back  # a copy
                else:
                    pairs.append(shared)
            if pairs:  # of two pages that are as near the one that shares more
                shared = max(pairs, key=len)
                out.append((r["rank"], r["page_id"], r["ph"], [x for x in r["loose"] if x in shared], len(shared), False))
                break
    cols = list(zip(*out)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.bool_())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["d_rank", "d_page", "d_ph", "gone", "n_shared", "further"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition with the number of each row and of its block of equal (host, same)."""
    at, block, last = 0, -1, None
    for b in batches:
        numbers = []
        for now in zip(b.column("host").to_pylist(), b.column("same").to_pylist()):
            block += now != last
            last = now
            numbers.append(block)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(at, at + b.num_rows), pa.int64()), pa.array(numbers, pa.int64())], [*b.schema.names, "at", "block_at"])
        at += b.num_rows


def shared_with_neighbour(pages: DataFrame) -> DataFrame:
    """d_page, d_ph, gone (numbers of the lines to delete), n_shared; pages (page_id, url, html, ph) without a pair are missing."""
    columns = "page_id long, ph long, host string, path string, lines array<long>, kept array<int>, loose array<int>, same long"
    order = ["host", "path", "page_id", "ph"]
    n = shuffle_partitions(pages.sparkSession)
    placed = arrow_map(pages, _outline, columns).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks, columns + ", at long, block_at long")
    placed = settled(placed.withColumn("part", F.spark_partition_id()))
    key = F.struct("host", "same")
    ends = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("block_at").alias("last"), F.min_by(key, "at").alias("a"), F.max_by(key, "at").alias("b")).collect()
    if not ends:
        return placed.sparkSession.createDataFrame([], T.StructType.fromDDL("d_page long, d_ph long, gone array<int>, n_shared long"))
    rank, block, before, offsets = 0, 0, None, {}
    for e in sorted(ends, key=lambda e: e.part):
        block -= before == e.a  # a block that goes on in the next partition
        offsets[e.part] = (rank, block)
        rank, block, before = rank + e.n, block + e.last + 1, e.b
    offset = lambda i: F.element_at(F.array(*(F.lit(offsets.get(p, (0, 0))[i]) for p in range(max(offsets) + 1))), F.col("part") + 1).cast("long")
    ranked = placed.withColumn("rank", offset(0) + F.col("at")).withColumn("block", offset(1) + F.col("block_at")).withColumn("run", F.floor(F.col("rank") / RUN)).withColumn("blocks", F.lit(block).cast("long"))
    ranked = ranked.drop("part", "at", "block_at", "same")
    runs = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(-REACH), F.lit(REACH)), lambda d: F.floor((F.col("rank") + d) / RUN)))
    own = F.col("run")
    both = ranked.withColumn("home", own).withColumn("run", F.explode(runs)).withColumn("asked", own == F.col("home")).withColumn("tip", F.lit(True)).drop("home")
    reach, parts, kinds = REACH, [], "d_rank long, d_page long, d_ph long, gone array<int>, n_shared long, further boolean"
    while True:
        found = settled(both.groupBy("run").applyInArrow(_compare, kinds))
        parts.append(found.where("not further").select("d_page", "d_ph", "gone", "n_shared"))
        further = found.where("further").select(F.col("d_rank").alias("rank"))
        if further.isEmpty():
            return functools.reduce(DataFrame.unionByName, parts)
        reach *= 8
        asked = settled(ranked.join(further, "rank"))
        need = asked.groupBy("run").agg(F.min("block").alias("x"), F.max("block").alias("y")).select("run", F.explode(F.sequence(F.col("x") - reach, F.col("y") + reach)).alias("block"))
        tips = ranked.select("rank", "block").groupBy("block").agg(F.min("rank").alias("x"), F.max("rank").alias("y")).join(need, "block")
        tips = tips.select("run", F.explode(F.array_distinct(F.array("x", "y"))).alias("rank"))
        tips = ranked.drop("run").join(tips, "rank").withColumns({"asked": F.lit(False), "tip": F.lit(True)})
        both = asked.withColumns({"asked": F.lit(True), "tip": F.lit(False)}).unionByName(tips)


def _extract(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, deleted = [], []
    for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
        lines = lines_of(page or "")
        gone = set(gone or ())
        deleted.append(len(gone))
        texts.append("\n".join(x for i, ((x, _), k) in enumerate(zip(lines, kept_lines(lines))) if k and i not in gone))
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("n_shared"), pa.array(deleted, pa.int64())],
        ["page_id", "url", "text", "n_chars", "n_shared", "n_deleted"],
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines shared with the nearest page), n_deleted (those of them that markup would have kept) of each page."""
    base = pick(pages, page_id="long", url="string", html="string").withColumn("ph", F.xxhash64("url", "html"))
    found = shared_with_neighbour(base)
    once = found.groupBy("d_page", "d_ph").agg(F.min_by("gone", F.size("gone")).alias("gone"), F.min("n_shared").alias("n_shared"))
    joined = base.join(once, base.page_id.eqNullSafe(once.d_page) & (base.ph == once.d_ph), "left")
    return arrow_map(
        joined.select("page_id", "url", "html", "gone", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared")),
        _extract,
        "page_id long, url string, text string, n_chars long, n_shared long, n_deleted long",
    )

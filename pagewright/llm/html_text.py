"""Main text of web pages: blocks by structure, nearest-URL page differencing of every page, and a check of what it finds.

The method. A page becomes blocks (lines). Structure decides first, as menus and adverts can differ from page to page:
blocks in containers that are furniture by their element or role (menus, footers, asides, forms, ...) go, and outside articles
also those whose class or id says so (adverts, notices, reader comments, ...). Headings, paragraphs and other elements
that aren't containers never go by a word, as their ids are often made from their text; inside an ``article`` or ``main``
element only a ``div`` goes, whose class is one of a few names (``comments``, ``ad``, ``ad-box``, ...). Where a page has such an
element, its other blocks may be text; of all other pages every open block may. Then each page is differenced:
pages are ordered by host, path and id; a page's partner is the neighbour on its host whose path agrees longest with its
own (the next one, if both do). The two pages' lines are aligned by a longest common subsequence, and shared lines
may be the site's furniture. A copy (a page crawled again, one article under two addresses) tells
nothing of furniture: where ``COPY_SHARE`` of the characters of either text are shared, the other neighbour is the
partner, or else the text stays.

The check. Outside articles all shared lines go. Inside one, a sentence that many articles hold is as shared as a menu (taken
unchecked, 148 of 2,500 pages of sf0.1 lost lines of their articles), so there shared lines go by whole containers:
those whose class has a word of furniture (a mark: neither it nor the sharing is enough alone), if the partner's article
holds every line of it under such a mark, too.

Scale. Pages move once, as blocks, range-partitioned by sampled splitters of their key; the first and the last page of a
range are sent to its neighbours as well, so a host of any size is spread over many tasks, which hold three pages each.
The driver holds at most ``SAMPLES_A_RANGE`` keys a range.

Defined results. Null or empty html: empty text, as for a page with nothing but furniture. Null url: a host of its own.
Repeated ids and rows: a row each; copies keep their text. Very long pages: a row held by one task, with its two
neighbours. Ties: the next page is the partner. An empty table: no rows. Extra columns don't take part.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import constant, parts_for, range_of, table

SAMPLES_A_RANGE = 32
#: A page is a copy of its partner if they share so much of the text of either.
COPY_SHARE = 0.8
#: Elements whose content is never text.
UNSEEN = frozenset("script style noscript template svg math iframe object head title select option textarea button canvas audio video map datalist".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements and roles that make a container furniture; containers whose class or id may do so, and its words.
FURNITURE = frozenset("nav footer aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTAINERS = frozenset("div section ul ol dl table ins center fieldset hgroup details".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist
cookie cookies consent copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices
notification pager pagination paywall popup popover promo promotion related reply replies respond search share sharing sidebar sidebars signup
skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
#: Class names of a ``div`` inside an article that isn't the article's: whole ones, and first parts of adverts'.
INSIDE = frozenset("sidebar comments commentlist comment-list comments-area cookie-notice cookie-banner".split())
ADVERTS = frozenset("ad ads advert adverts advertisement adsbygoogle".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|template)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)""", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: KEPT: in an article; MARKED: there, and in a container with a mark.
DROPPED, OPEN, KEPT, MARKED = 0, 1, 2, 3


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if in_article and name == "class" and tag in ("div", "ins") and any(x in INSIDE or re.split("[-_]", x)[0] in ADVERTS for x in value.lower().split()):
            return True
        if not in_article and name in ("class", "id") and tag in CONTAINERS and any(w.lower() in WORDS for w in _WORD.findall(value)):
            return True
    return False


def _is_marked(tag: str, attributes: str) -> bool:
    """Whether a container's class (not its id, which may be made from a heading) has a word of furniture."""
    return tag in CONTAINERS and any(
        name.lower() == "class" and any(w.lower() in WORDS for w in _WORD.findall(a or b or c)) for name, a, b, c in _NAMED.findall(attributes)
    )


def page_blocks(source: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with DROPPED, OPEN or KEPT."""
    return [(text, min(kind, KEPT)) for text, kind in marked_blocks(source)[0]]


def marked_blocks(source: str) -> tuple[list[tuple[str, int]], list[int]]:
    """The blocks of a page in order, each with its kind; and where marked containers of articles start and end in them."""
    out: list[tuple[str, int]] = []
    marks: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # container, furniture around it, articles around it, first block if marked or -1
    furniture = articles = marked = at = 0

    def close() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                out.append((text, DROPPED if furniture else OPEN if not articles else MARKED if marked else KEPT))
            held.clear()

    def leave(containers: list[tuple[str, int, int, int]]) -> None:
        nonlocal marked
        for *_, first in containers:
            if first >= 0:
                marked -= 1
                marks.extend((first, len(out)))

    for m in _MARKUP.finditer(source):
        if m.start() > at:
            held.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK:
            close()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    _, furniture, articles, _ = stack[i]
                    leave(stack[i:])
                    del stack[i:]
                    break
            continue
        bad = _is_furniture(tag, m[4] or "", bool(articles)) or tag in UNSEEN
        if bad and tag not in BLOCK:
            close()
        if bad or tag in BLOCK and tag not in ("p", "li", "hr", "td", "th", "tr", "dt", "dd"):
            if not (m[4] or "").rstrip().endswith("/") or tag in BLOCK:
                mark = bool(articles and m[4]) and not (bad or furniture) and _is_marked(tag, m[4])
                stack.append((tag, furniture, articles, len(out) if mark else -1))
                marked += mark
                furniture += bad
                articles += tag in ("article", "main")
    if at < len(source):
        held.append(html.unescape(source[at:]))
    close()
    leave(stack)
    return out, marks


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``, by the matches' longest rising chain."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least last place in b of a chain of each length
    tops: list[tuple] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, tops[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tops.append(link)
            else:
                ends[k], tops[k] = j, link
    out, link = set(), tops[-1] if tops else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _least_kind(blocks: list[tuple[str, int]]) -> int:
    """Blocks of this kind or a higher one may be text."""
    return KEPT if any(kind >= KEPT for _, kind in blocks) else OPEN


def _shared_text(blocks: list[tuple[str, int]], other: list[tuple[str, int]]) -> tuple[set[int], float]:
    """Places of the text's blocks that are shared with another page, and how much of the text's characters they are."""
    least = _least_kind(blocks)
    shared = {i for i in shared_lines([t for t, _ in blocks], [t for t, _ in other]) if blocks[i][1] >= least}
    return shared, sum(len(blocks[i][0]) for i in shared) / max(1, sum(len(t) for t, kind in blocks if kind >= least))


def _confirmed(blocks: list[tuple[str, int]], partner: list[tuple[str, int]], marks: list[int]) -> set[int]:
    """Places of an article's marked containers that are shared whole: their lines, aligned with the partner's marked ones."""
    inside = [i for i, (_, kind) in enumerate(blocks) if kind == MARKED]
    shared = {inside[k] for k in shared_lines([blocks[i][0] for i in inside], [t for t, kind in partner if kind == MARKED])}
    own = list(accumulate((kind == MARKED and i not in shared for i, (_, kind) in enumerate(blocks)), initial=0))
    return {i for lo, hi in zip(marks[::2], marks[1::2], strict=True) if own[lo] == own[hi] for i in range(lo, hi)}


def main_text(blocks: list[tuple[str, int]], partners: list[list[tuple[str, int]]], marks: list[int] = ()) -> str:
    """The blocks that may be text, but for the furniture they share with the first partner that isn't a copy."""
    least, furniture = _least_kind(blocks), set()
    for partner in partners:
        shared, share = _shared_text(blocks, partner)
        if not shared or max(share, _shared_text(partner, blocks)[1]) < COPY_SHARE:
            furniture = shared if least == OPEN else _confirmed(blocks, partner, marks)
            break
    return "\n".join(t for i, (t, kind) in enumerate(blocks) if kind >= least and i not in furniture)


def _key(url: str | None, page: int | None) -> str:
    """Host, path and id as one string that sorts as they do; NUL, which sorts first, parts them."""
    try:
        parts = urlsplit(url or "")
        host, path = parts.netloc.lower(), parts.path.rstrip("/")
    except ValueError:
        host, path = "", url or ""
    return f"{host}\0{path}\0{(page or 0) + (1 << 63):020d}"


def _agreement(a: str, b: str) -> int:
    """-1 on different hosts, else how many characters the two paths share from the start."""
    (host, path, _), (other, beside, _) = a.split("\0", 2), b.split("\0", 2)
    if host != other:
        return -1
    n = 0
    for x, y in zip(path, beside):
        if x != y:
            break
        n += 1
    return n


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                urls, ids = b.column("url").to_pylist(), b.column("id").to_pylist()
                found = [marked_blocks(x or "") for x in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array([_key(u, i) for u, i in zip(urls, ids, strict=True)]), pa.array([[t for t, _ in x] for x, _ in found], pa.list_(pa.string())), pa.array([bytes(k for _, k in x) for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int32()))], ["id", "url", "key", "lines", "kinds", "marks"])

    def key_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(u, i) for u, i in zip(b.column("url").to_pylist(), b.column("id").to_pylist(), strict=True)], pa.string())], ["key"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keys = rows.select("id", "url").mapInArrow(key_only, "key string")  # splitters need no html
    parts = parts_for(pages)
    n = rows.count()
    sample = sorted(r["key"] for r in keys.filter(F.rand(1) < F.lit(SAMPLES_A_RANGE * parts / max(n, 1))).collect())
    splitters = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    ends = sorted((r["range"], r["lo"], r["hi"]) for r in keys.withColumn("range", range_of(F.col("key"), splitters, "string")).groupBy("range").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect())
    parsed = rows.mapInArrow(parse, f"id {kind}, url string, key string, lines array<string>, kinds binary, marks array<int>")
    spread = parsed.withColumn("range", range_of(F.col("key"), splitters, "string"))
    lo, hi, before, after = ([None] * (len(splitters) + 1) for _ in range(4))
    for i, (r, first, last) in enumerate(ends):
        lo[r], hi[r] = first, last
        before[r] = ends[i - 1][0] if i else None
        after[r] = ends[i + 1][0] if i + 1 < len(ends) else None

    def look_up(values: list, cast: str) -> F.Column:
        return F.get(constant(values, cast), F.col("range"))

    def place(where: F.Column, guest: bool) -> F.Column:
        return F.struct(where.alias("r"), F.lit(guest).alias("guest"))

    to_before = F.when(F.col("key") == look_up(lo, "string"), place(look_up(before, "int"), True))
    to_after = F.when(F.col("key") == look_up(hi, "string"), place(look_up(after, "int"), True))
    places = F.filter(F.array(place(F.col("range"), False), to_before, to_after), lambda p: p.isNotNull() & p["r"].isNotNull())
    spread = spread.withColumn("p", F.explode(places)).select("id", "url", "key", "lines", "kinds", "marks", F.col("p.r").alias("range"), F.col("p.guest").alias("guest"))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = [id_col, url_col, "text", "n_chars"], []
        prev = now = None

        def judge(follower: tuple | None) -> None:
            if now is None or now[6]:
                return
            beside = [(same, other) for other in (follower, prev) if other is not None and (same := _agreement(now[2], other[2])) >= 0]
            beside.sort(key=lambda x: -x[0])  # the follower first, if both agree alike
            text = main_text(list(zip(now[3], now[4], strict=True)), [list(zip(o[3], o[4], strict=True)) for _, o in beside], now[5])
            out.append((now[0], now[1], text, len(text)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (ids, pa.string(), pa.string(), pa.int64()), strict=True)], names)
            out.clear()
            return batch

        ids = pa.int64()
        for b in batches:
            ids = b.column("id").type
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "url", "key", "lines", "kinds", "marks", "guest")), strict=True):
                judge(row)
                prev, now = now, row
                if len(out) >= 256:
                    yield flush()
        judge(None)
        if out:
            yield flush()

    spread = spread.repartitionById(len(splitters) + 1, F.col("range")).sortWithinPartitions("key", "lines")
    return spread.mapInArrow(difference, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))

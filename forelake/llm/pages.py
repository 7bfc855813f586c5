"""Main text of web pages by differencing pages with near URLs."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.joins import join_small
from forelake.llm.common import stage
from forelake.llm.fingerprints import following

# Elements of HTML by role.
_ASIDE = "nav footer aside form dialog menu menuitem fieldset label input".split()
_INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source input"
).split()
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words in class, id or role that mark parts beside the text.
_MARKS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended comment comments "
    "commentlist respond reply replies disqus discussion pagination pager search searchform widget alert toast skip hidden complementary contentinfo navigation dialog form"
).split()
#: What may stand before or after such a word in one class token; "has-sidebar" or "social-site" name something else.
_FILLERS = (
    "site page main global primary secondary post entry left right top bottom first last list box block area slot unit link links button buttons bar icons item items section inner text "
    "fixed sticky mobile desktop small large icon title"
).split()
_NOT_LAST = ("site", "page", "main", "post", "entry", "text")
#: Marks that go for an article, too: other texts than the page's own.
_CARDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended comment comments commentlist respond reply replies disqus discussion".split())
_HEADER = ("header", "head", "pageheader")
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|title|textarea|template|noscript|iframe|svg|math|object|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CARD_TAGS = set("nav footer aside dialog menu menuitem".split())
_OPEN_TEXT = set("p pre blockquote".split())
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_INLINES, _VOIDS, _ASIDES, _MARKED, _FILLED = set(_INLINE), set(_VOID), set(_ASIDE), set(_MARKS), set(_MARKS) | set(_FILLERS) | set(_HEADER)
_NAMES = _MARKED | set(_HEADER)
#: Two pages are near copies, which tell nothing about the frame around a text, if they leave less than this part of the smaller one's characters unshared.
OWN_SHARE = 0.1
#: From this shared part on, a pair may as well be two versions of a text: the host's other pages decide about its shared lines.
DOUBT_SHARE = 0.6
#: Shared lines in article or main, or in doubt, are text if differencing finds them on at most one in so many pages of the host.
FEW_PAGES = 4


_PAGE = "struct<path:string,keys:array<bigint>,total:bigint>"
_RUN = f"struct<path:string,keys:array<bigint>,sizes:array<int>,main:binary,copies:array<boolean>,before:{_PAGE},after:{_PAGE}>"
_PAGE_ARROW = pa.struct({"path": pa.string(), "keys": pa.list_(pa.int64()), "total": pa.int64()})
_RUN_ARROW = pa.struct({"path": pa.string(), "keys": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "main": pa.binary(), "copies": pa.list_(pa.bool_()), "before": _PAGE_ARROW, "after": _PAGE_ARROW})


@dataclass
class Line:
    text: str
    main: bool  # inside article or main
    beside: bool  # inside a part that is named as no text


@dataclass
class Part:
    """An element that is named as no text."""

    card: bool  # holds other texts, so that articles inside are beside as well
    form: bool
    text: bool = False  # a form with a paragraph, article or main inside is a wrapper of the page


def _marks(attributes: str) -> set[str]:
    """Words of _MARKS and _HEADER that are class, id or role tokens, alone or with fillers only ("site-footer")."""
    found: set[str] = set()
    for v in _NAMED.finditer(attributes):
        for token in (v[1] or v[2] or v[3] or "").split():
            words = [w for w in _SPLIT.split(_CASE.sub("-", token).lower()) if w]
            if words and words[-1] not in _NOT_LAST and _FILLED.issuperset(words):
                found |= _NAMES.intersection(words)
    return found


def page_lines(source: str) -> list[Line]:
    """The page's blocks in order, white space folded, references decoded; scripts and styles are left out."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, tuple[Part, ...]]] = []  # name, main, parts around it
    held: list[str] = []
    around: list[tuple[Part, ...]] = []

    def flush() -> None:
        words = html.unescape("".join(held)).split()
        held.clear()
        if words:
            main, parts = stack[-1][1:] if stack else (False, ())
            if parts and parts[-1].form:
                inside = takewhile(lambda s: s[0] != "form", reversed(stack))
                parts[-1].text |= any(s[0] in _OPEN_TEXT for s in inside)
            lines.append(Line(" ".join(words), main, False))
            around.append(parts)

    at = 0
    for m in _SKIP.finditer(source):
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1] and m[1].lower() not in _INLINES:
                held.append(" ")
            continue
        if name == "br":  # white space inside its block
            held.append(" ")
            continue
        if name not in _INLINES or name in _ASIDES:
            flush()
        if m[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in _INLINES:
                        if all(s[0] in _INLINES for s in stack[depth:]):
                            del stack[depth:]
                    else:
                        del stack[depth:]
                    break
        elif name not in _VOIDS and not m[4].endswith("/"):
            main, parts = stack[-1][1:] if stack else (False, ())
            if name == "p":  # a paragraph ends an open one
                while stack and (stack[-1][0] in _INLINES or stack[-1][0] == "p"):
                    if stack.pop()[0] == "p":
                        break
                main, parts = stack[-1][1:] if stack else (False, ())
            marks = _marks(m[4]) if m[4] else set()
            if name == "main" or (name == "article" and not marks & _CARDS and not any(x.card for x in parts)):
                # A mark on what contains the text does not reach it.
                for part in parts:
                    part.text = True
                main, parts = True, ()
            elif name == "h1" and not any(x.card for x in parts):
                parts = ()
            elif name not in ("html", "body"):
                named = bool(marks & _MARKED) or (not main and (name == "header" or bool(marks)))
                if named and name in _INLINES and not parts:
                    flush()
                if name in _ASIDES or named:
                    form = name == "form" and not marks - {"form"}
                    parts = (*parts, Part(bool(marks & _CARDS) or name in _CARD_TAGS, form))
            stack.append((name, main, parts))
    held.append(source[at:])
    flush()
    for line, parts in zip(lines, around, strict=True):
        line.beside = any(not (x.form and x.text) for x in parts)
    return lines


def body_lines(source: str) -> list[Line]:
    """Lines that may be text: none beside it."""
    return [x for x in page_lines(source) if not x.beside]


def text_lines(lines: list[Line], gone: int) -> list[str]:
    """Text of the lines that no bit of ``gone`` marks; only those in article or main if a page has such lines."""
    inner = any(x.main for x in lines)
    return [x.text for i, x in enumerate(lines) if not gone >> i & 1 and (x.main or not inner)]


def line_keys(lines: list[Line]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(x.text.encode("utf-8", "surrogatepass")) - 2**63 for x in lines]


def aligned(one: list[int], other: list[int]) -> list[int]:
    """Indices of ``one`` on a longest common subsequence with ``other``.

    Equal ends are taken first; between them one bit per line of ``one`` follows all
    columns of the table at once, and a pass back over the rows reads off the lines.
    """
    lo = 0
    while lo < min(len(one), len(other)) and one[lo] == other[lo]:
        lo += 1
    hi = 0
    while hi < min(len(one), len(other)) - lo and one[-1 - hi] == other[-1 - hi]:
        hi += 1
    a, b = one[lo : len(one) - hi], other[lo : len(other) - hi]
    shared = set(a) & set(b)
    b = [k for k in b if k in shared]
    kept = [i for i, k in enumerate(a) if k in shared]
    where: dict[int, int] = {}
    for i, full in enumerate(kept):
        where[a[full]] = where.get(a[full], 0) | 1 << i
    ones = (1 << len(kept)) - 1
    row, rows = ones, []
    for k in b:
        rows.append(row)
        u = row & where[k]
        row = ((row + u) | (row - u)) & ones
    found, i = [], len(kept) - 1
    for j in range(len(b) - 1, -1, -1):
        # A zero bit at i: the prefix up to i is longer by one than without it.
        while i >= 0 and row >> i & 1:
            i -= 1
        if i < 0:
            break
        if rows[j] >> i & 1:
            found.append(lo + kept[i])
            i -= 1
        row = rows[j]
    return [*range(lo), *reversed(found), *range(len(one) - hi, len(one))]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path with its query, without scheme and fragment."""
    rest = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    return host, F.substring(rest, F.length(host) + 1, F.lit(2**31 - 1))


def _nearest(path: str, others: list[dict | None], keys: list[int], sizes: list[int]) -> tuple[list[int], list[bool]]:
    """Indices of the lines shared with the nearest page of the host that is no near copy, and which of ``others`` are near copies."""

    def common(o: dict) -> int:
        k = 0
        while k < min(len(path), len(o["path"])) and path[k] == o["path"][k]:
            k += 1
        return k

    total, copies, nearest = sum(sizes), [], ([], -1)
    for o in others:
        shared = aligned(keys, o["keys"]) if o else []
        smaller = min(total, o["total"]) if o else 0
        copies.append(bool(o) and smaller - sum(sizes[i] for i in shared) < OWN_SHARE * smaller)
        if o and not copies[-1] and common(o) > nearest[1]:
            nearest = shared, common(o)
    return nearest[0], copies


def _bitmap(places: list[int]) -> bytes:
    bits = 0
    for i in places:
        bits |= 1 << i
    return bits.to_bytes(-(-bits.bit_length() // 8), "little")


def beside_runs(runs: DataFrame, tasks: int) -> DataFrame:
    """``runs`` with the pages before and after each row's run of near copies, null at the ends of a host.

    The first row of a run knows the page before it, the last row the page after it.
    Both are carried along ranges of rows; what goes over the edge of a range meets
    in one small table.
    """
    order = ["host", "path", "mark"]
    held = lambda c, i: F.when(~F.col("copies")[i], F.struct("host", F.col(c).alias("page")))
    rows = stage(runs.repartitionByRange(tasks, *order).withColumn("__part", F.spark_partition_id()).withColumn("before", held("before", 0)).withColumn("after", held("after", 1)))
    down, up = Window.partitionBy("__part").orderBy(*order), Window.partitionBy("__part").orderBy(*[F.desc(c) for c in order])
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    ends = rows.groupBy("__part").agg(F.max_by("before", at("before")).alias("b"), F.min_by("after", at("after")).alias("a"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    # One row per range.
    ends = ends.select("__part", F.last("b", True).over(earlier(Window.orderBy("__part"))).alias("__b"), F.last("a", True).over(earlier(Window.orderBy(F.desc("__part")))).alias("__a"))
    found = rows.withColumn("before", F.last("before", True).over(so_far(down))).withColumn("after", F.last("after", True).over(so_far(up))).join(ends, "__part")
    page = lambda c, carried: F.when(F.coalesce(c, carried)["host"] == F.col("host"), F.coalesce(c, carried)["page"])
    return found.withColumn("before", page("before", "__b")).withColumn("after", page("after", "__a"))


def with_frame(near: DataFrame) -> DataFrame:
    """``near`` with ``spared``, the places of doubted lines that few pages of their host share, for ``places`` and ``lines``.

    The lines that are not few are a short list per host: each takes up a quarter of its pages.
    """
    hosts = near.groupBy("host").agg(F.count("*").alias("pages"))
    found = near.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    frame = join_small(found, hosts, ["host"]).where(F.col("n") * FEW_PAGES > F.col("pages"))
    frame = frame.groupBy("host").agg(F.collect_list("line").alias("frame"))
    few = F.filter(F.arrays_zip("places", "lines"), lambda x: ~F.array_contains(F.coalesce("frame", F.array().cast("array<long>")), x["lines"]))
    return join_small(near, frame, ["host"], "left").select("host", "mark", "shared", F.transform(few, lambda x: x["places"]).alias("spared"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page.

    Pages are put in order of host and URL path; each is paired with the nearer of
    its two neighbours of the same host (longest common path). Whole copies are
    collapsed beforehand; where all neighbours are near copies, the run of near copies is
    passed over and the pages before and after it are taken. Their lines are aligned by longest common subsequence, on 64-bit
    line hashes, where the neighbours meet; only a bitmap of shared lines returns to the
    page. Shared lines go. Those inside article or main, or of a pair that shares
    most of its characters, stay if differencing finds the
    line on few pages of the host (a quarter at most, copies counted once): passages that
    recur in some articles are text, a frame is on most pages. Parts that are
    named as menus, headers, footers, sidebars, notices, adverts, forms or comments
    go with their markup, but not an article, main or h1 inside (unless in comments, adverts,
    related texts or a nav, footer or aside element), and no form that holds paragraphs. Line breaks and block elements separate lines.

    Null html counts as empty and gives an empty text. Null URLs are one host with
    empty path. Repeated rows are copies of each other. Empty tables give no rows.
    """
    host, path = url_parts(F.col("url"))
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(F.col("url").cast("string"), source).alias("sig"), host.alias("host"), path.alias("path"), source.alias("html"))

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [body_lines(h.as_py()) for h in batch.column(4)]
            keys, sizes = pa.array([line_keys(x) for x in lines], pa.list_(pa.int64())), pa.array([[len(y.text) for y in x] for x in lines], pa.list_(pa.int32()))
            main = pa.array([_bitmap([i for i, y in enumerate(x) if y.main]) for x in lines], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], keys, sizes, main], names=["host", "path", "page_id", "sig", "keys", "sizes", "main"])

    hashed = rows.select("host", "path", "page_id", "sig", "html").mapInArrow(hash_lines, "host string, path string, page_id long, sig long, keys array<long>, sizes array<int>, main binary").withColumn("mark", F.xxhash64("keys", "main"))
    # Pages of a host with equal lines stand in the order once, so that every neighbour differs.
    distinct = hashed.groupBy("host", "mark").agg(F.min(F.struct("path", "keys", "sizes", "main")).alias("one")).select("host", "one.path", "mark", "one.keys", "one.sizes", "one.main", F.aggregate("one.sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = following(distinct, ["host", "path", "mark"], tasks)
    slim = lambda c: F.when((F.col(f"{c}.host") == F.col("host")) & (F.col(f"{c}.mark") != F.col("mark")), F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("path", "keys", "total")]))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, places, lines, unsettled, runs = [], [], [], [], []
            for path, keys, sizes, main, before, after in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                found, copies = _nearest(path, [before, after], keys, sizes)
                inside = int.from_bytes(main, "little")
                doubt = sum(sizes[i] for i in found) >= DOUBT_SHARE * sum(sizes)
                doubted = [i for i in found if doubt or inside >> i & 1]
                shared.append(_bitmap(found))
                places.append(doubted)
                lines.append([keys[i] for i in doubted])
                unsettled.append(any(copies) and all(c or not o for c, o in zip(copies, (before, after), strict=True)))
                # Rows of a run bring what stands beside it.
                before, after = (None if c else o for c, o in zip(copies, (before, after), strict=True))
                runs.append({"path": path, "keys": keys, "sizes": sizes, "main": main, "copies": copies, "before": before, "after": after} if any(copies) else None)
            columns = [*batch.columns[:2], pa.array(shared, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(lines, pa.list_(pa.int64())), pa.array(unsettled, pa.bool_()), pa.array(runs, _RUN_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "mark", "shared", "places", "lines", "unsettled", "run"])

    page, out = ["host", "mark", "path", "keys", "sizes", "main"], f"host string, mark long, shared binary, places array<int>, lines array<long>, unsettled boolean, run {_RUN}"
    first = stage(near.select(*page, slim("before").alias("before"), slim("after").alias("after")).mapInArrow(align, out))
    runs = beside_runs(first.where("run is not null").select("host", "mark", "unsettled", "run.*"), tasks)
    second = runs.where("unsettled").select(*page, "before", "after").mapInArrow(align, out)
    near = stage(first.where("not unsettled").unionByName(second).drop("unsettled", "run"))
    near = with_frame(near)
    near = hashed.select("page_id", "sig", "host", "mark").distinct().join(near, ["host", "mark"]).select(F.col("page_id").alias("near_id"), F.col("sig").alias("near_sig"), "shared", "spared")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, marks, spared in zip(*(c.to_pylist() for c in batch.columns[2:5]), strict=True):
                gone = int.from_bytes(marks or b"", "little")
                for i in spared or ():
                    gone &= ~(1 << i)
                texts.append("\n".join(text_lines(body_lines(source), gone)))
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lengths)], names=["page_id", "url", "text", "n_chars"])

    # Host and path follow from the URL; they need no place in the shuffle of the pages.
    rows = rows.select("page_id", "url", "sig", "html")
    paired = rows.join(near, rows["page_id"].eqNullSafe(near["near_id"]) & (rows["sig"] == near["near_sig"]), "left")
    return paired.select("page_id", "url", "html", "shared", "spared").mapInArrow(difference, "page_id long, url string, text string, n_chars long")

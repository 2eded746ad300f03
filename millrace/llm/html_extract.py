"""HTML extraction by nearest-URL page differencing.

Every page is paired with the page whose URL path is nearest to its own among the pages of its host that have other text,
the text lines of the two are aligned by longest common subsequence, and lines that both pages share are deleted as site
furniture.  The page's own structure overrules the comparison where it speaks plainly: lines inside an article (or main)
element stay even if another page repeats them, and lines inside navigation, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or reader comments go even if they are unique.  The comparison decides all other lines, but for pages
of which it would leave nothing: these keep their lines.

Plan.  (1) Pages are parsed for the hashes of their lines, which are written (a few bytes a line, where the lines would
double the disk that the last join takes).  (2) Pages of one host with the same lines are copies and take part once, as the one with the least path.
(3) URLs alone are range-partitioned, sorted by host and path and written; each partition pairs its neighbours, and only the
first and last URL of each partition meet again on the driver, so a host with a third of all pages is spread over many tasks.
(4) Line hashes of each page are sent once to the page that compares itself with them; the alignment takes memory in line with
the lines.  (5) The deleted line
numbers, usually none or few, are joined to the lines of a second parse.

Defined results.  Null html is empty text; a page alone on its host, or with copies of itself only, is decided by structure;
null or unparsable URLs form a host of their own.  Rows equal in page_id, url and html are one page and each return a row.
Ties between two neighbours go to the earlier in order of path and row.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.near_dedup import checkpointed

MAIN, OTHER = 1, 0
#: Elements whose content is never main text.
DROPPED = frozenset("script style noscript template nav header footer aside form button select textarea iframe svg object canvas dialog menu title".split())
#: Of those, elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others begin and end a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a following block element closes.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words of a class, id or role that mark an element as furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login comment comments commentlist discussion disqus replies respond related share sharing social pagination pager search toolbar widget skip complementary contentinfo dialog alert disclaimer".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\s(?:hidden(?=[\s>/=])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+")
#: Class names that speak of a neighbour, such as has-sidebar.
ABOUT = re.compile(r"(?:has|with|without|no|is)[-_]", re.I)


def is_furniture(tag: str) -> bool:
    if " " not in tag and "\t" not in tag and "\n" not in tag:
        return False
    if HIDDEN.search(tag):
        return True
    marks = " ".join(a or b or c for a, b, c in MARKS.findall(tag))
    return any(w.lower() in FURNITURE for mark in marks.split() if not ABOUT.match(mark) for w in SPLIT.split(mark))


def page_lines(page: str) -> list[tuple[str, int]]:
    """Text lines of a page outside furniture, in order, each MAIN (in an article or main element) or OTHER.

    Markup may be unclosed or cut off.  White space, tags inside a line and character references are resolved.
    """
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, begins furniture, begins main text
    furniture = main = 0
    at = 0

    def flush() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            if line:
                lines.append((line, MAIN if main else OTHER))
            parts.clear()

    def pop() -> None:
        nonlocal furniture, main
        _, f, m = stack.pop()
        furniture -= f
        main -= m

    while token := TOKEN.search(page, at):
        begin, end = token.span()
        if begin > at and not furniture:
            parts.append(page[at:begin])
        at = end
        name = TAG.match(token[0])
        if not name:
            continue
        element = name[2].lower()
        if element not in INLINE:
            flush()
        elif element == "br":
            parts.append(" ")
        if name[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == element:
                    while len(stack) > i:
                        pop()
                    break
            continue
        if element not in INLINE:  # unclosed inline elements end with their block
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES and element in CLOSES[stack[i][0]]:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ("p", "dt", "dd", "td", "th"):
                    break
        if element in VOID or token[0].endswith("/>") and element in ("svg",):
            continue
        bad = element in DROPPED or (element not in ("html", "body", "article", "main") and is_furniture(token[0]))
        good = element in ("article", "main")
        stack.append((element, bad, good))
        furniture += bad
        main += good
        if element in RAW:
            last = re.compile(rf"</{re.escape(element)}(?=[\s>/]|\Z)", re.I).search(page, at)
            at = last.start() if last else len(page)
    if not furniture:
        parts.append(page[at:])
    flush()
    return lines


#: Bits of alignment rows that are held at once; longer pages are halved first.
ALIGN_BITS = 1 << 26


class Masks:
    """For a value of b the bits of its places; those of rare values are made when asked for, so that memory stays small."""

    def __init__(self, b: list[int]) -> None:
        self.size = len(b)
        self.places: dict[int, list[int]] = {}
        for j, x in enumerate(b):
            self.places.setdefault(x, []).append(j)
        self.kept = {x: self.made(found) for x, found in self.places.items() if len(found) >= 64}

    def made(self, found: list[int]) -> int:
        if len(found) <= 8:
            return sum(1 << j for j in found)
        flags = np.zeros(self.size, dtype=np.uint8)
        flags[found] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def __getitem__(self, x: int) -> int:
        return self.kept[x] if x in self.kept else self.made(self.places.get(x, []))


def advance(row: int, m: int, full: int) -> int:
    """The next bit-parallel row: a zero bit j says that b[j] lengthens the common part of what was read of a."""
    u = row & m
    return ((row + u) | (row - u)) & full


def common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a and each b[:j]."""
    masks, full = Masks(b), (1 << len(b)) - 1
    row = full
    for x in a:
        if x in masks.places:
            row = advance(row, masks[x], full)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, in memory of ALIGN_BITS and the lines (Hirschberg's halving)."""
    out, low = [], 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        out.append(low)
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    tail = list(range(len(a) - high, len(a)))
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return out + tail
    if len(a) > 1 and len(a) * len(b) > ALIGN_BITS:
        half = len(a) // 2
        cut = int(np.argmax(common_lengths(a[:half], b) + common_lengths(a[half:][::-1], b[::-1])[::-1]))
        found = shared_lines(a[:half], b[:cut]) + [half + i for i in shared_lines(a[half:], b[cut:])]
        return out + [low + i for i in found] + tail
    masks, full = Masks(b), (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        row = advance(row, masks[x], full)
        rows.append(row)
    i, j, found = len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            found.append(low + i)
            i, j = i - 1, j - 1
    return out + found[::-1] + tail


def url_key():
    """Host and path of a URL; neither scheme, query nor fragment counts."""
    url = F.coalesce(F.col("url"), F.lit(""))
    bare = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    bare = F.regexp_extract(bare, r"^[^?#]*", 0)
    return F.lower(F.regexp_extract(bare, r"^[^/]*", 0)).alias("host"), F.regexp_replace(F.regexp_extract(bare, r"/.*$", 0), "/+$", "").alias("path")


def near(a: str, b: str) -> int:
    """Length of the common prefix of two paths."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


def nearest_pages(pages: DataFrame) -> DataFrame:
    """row_id and partner_id: for each page, the neighbour in order of (host, path, row) with the longer common path.

    The two neighbours in that order have the longest common prefixes of all pages of the host; ties go to the earlier.
    """
    # written, as a second run would sample other bounds
    spread = checkpointed(pages.repartitionByRange("host", "path", "row_id").sortWithinPartitions("host", "path", "row_id"))
    kind = "first_host string, first_path string, first_id string, last_host string, last_path string, last_id string"

    def edges(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                rows = b.slice(0, 1).to_pylist() + b.slice(b.num_rows - 1).to_pylist()
                first, last = first or rows[0], rows[1]
        if first:
            yield pa.RecordBatch.from_pylist([{f"{n}_{c}": r[k] for n, r in (("first", first), ("last", last)) for c, k in (("host", "host"), ("path", "path"), ("id", "row_id"))}])

    # at most one row a partition
    ends = sorted(spread.mapInArrow(edges, kind).collect(), key=lambda r: (r.first_host, r.first_path, r.first_id))
    before = {r.first_id: (p.last_host, p.last_path, p.last_id) for p, r in zip(ends, ends[1:])}
    after = {r.last_id: (n.first_host, n.first_path, n.first_id) for r, n in zip(ends, ends[1:])}

    def choose(previous, row, following):
        best = None
        for other in (previous, following):
            if other and other[0] == row[0] and (best is None or near(other[1], row[1]) > near(best[1], row[1])):
                best = other
        return best and best[2]

    def pair(batches):
        previous = row = None
        for b in batches:
            out = []
            for following in zip(*(b.column(i).to_pylist() for i in range(3))):
                if row:
                    out.append((row[2], choose(previous or before.get(row[2]), row, following)))
                previous, row = row, following
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["row_id", "partner_id"])
        if row:
            last = choose(previous or before.get(row[2]), row, after.get(row[2]))
            yield pa.RecordBatch.from_arrays([pa.array([row[2]], pa.string()), pa.array([last], pa.string())], names=["row_id", "partner_id"])

    return spread.mapInArrow(pair, "row_id string, partner_id string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_lines, n_deleted (lines outside articles that the nearest page shares)."""
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    row_id = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.xxhash64("url").cast("string"), F.lit("")), "html").cast("binary"))
    keyed = pages.withColumn("row_id", row_id)

    def mark(batches):
        import xxhash

        for b in batches:
            hashes = [np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x, _ in page_lines(p)], dtype=np.uint64).view(np.int64) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(hashes, pa.list_(pa.int64())), pa.array([xxhash.xxh3_128_hexdigest(h.tobytes()) for h in hashes], pa.string())], names=[*b.schema.names[1:], "hashes", "digest"])

    def parse(batches):
        for b in batches:
            found = [page_lines(x) for x in b.column(0).to_pylist()]
            lines, kinds = pa.array([[x for x, _ in p] for p in found], pa.list_(pa.string())), pa.array([[k for _, k in p] for p in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lines, kinds], names=[*b.schema.names[1:], "lines", "kinds"])

    marks = checkpointed(keyed.select("html", *url_key(), "row_id").mapInArrow(mark, "host string, path string, row_id string, hashes array<long>, digest string").dropDuplicates(["row_id"]))
    hashes, places = marks.select("row_id", "hashes"), marks.select("host", "path", "row_id", "digest")
    texts = places.groupBy("host", "digest").agg(F.min(F.struct("path", "row_id")).alias("at"))
    firsts = texts.select("host", "at.path", "at.row_id")
    partners = nearest_pages(firsts)
    asked = partners.where("partner_id is not null").join(hashes.withColumnsRenamed({"row_id": "partner_id", "hashes": "others"}), "partner_id").join(hashes, "row_id")

    def compare(batches):
        for b in batches:
            kept, deleted = [], []
            for row, mine, others in zip(*(b.column(i).to_pylist() for i in range(3))):
                if shared := shared_lines(mine, others):
                    kept.append(row)
                    deleted.append(shared)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(deleted, pa.list_(pa.int32()))], names=["first_id", "shared"])

    compared = asked.select("row_id", "hashes", "others").mapInArrow(compare, "first_id string, shared array<int>")
    copies = places.join(texts.select("host", "digest", F.col("at.row_id").alias("first_id")), ["host", "digest"]).select("row_id", "first_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.select("page_id", "url", "row_id").schema)
    parsed = keyed.select("html", "page_id", "url", "row_id").mapInArrow(parse, f"{schema}, lines array<string>, kinds array<int>")
    joined = parsed.join(copies.join(compared, "first_id").select("row_id", "shared"), "row_id", "left")
    tagged = F.transform("lines", lambda x, i: F.struct(x.alias("line"), ((F.get("kinds", i) == F.lit(MAIN)) | ~F.coalesce(F.array_contains("shared", i), F.lit(False))).alias("stays")))
    own = F.transform(F.filter(tagged, lambda x: x["stays"]), lambda x: x["line"])
    kept = F.when(F.col("shared").isNull(), F.col("lines")).when(F.size("own") > 0, F.col("own")).otherwise(F.col("lines"))
    out = joined.withColumn("own", F.when(F.col("shared").isNotNull(), own)).withColumn("kept", kept)
    return out.select("page_id", "url", F.array_join("kept", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_deleted"))

"""Main text of pages by nearest-URL page differencing (operator 10).

Pages are sorted by host and URL path; a page's pair is the one of its two neighbours
of the same host whose path has the longer beginning in common. The text lines
(blocks) of both are aligned by a longest common subsequence, and lines in it are
template and go. Two things stand above the differencing: what the mark-up itself
calls navigation, advert, form, comment and the like goes whether shared or not; and
lines inside an ``article`` or ``main`` element stay though they are shared, since
sites publish the same article under several addresses and sentences recur. Lines outside of
them are decided by the differencing alone; beside an ``article`` they need a pair, as
nothing else tells template from text there. A page that would be left empty is a copy
of its pair and keeps its lines.

Mark-up is read as it comes: a quote opens a value only behind an equals sign, an
``article`` or ``main`` ends what was left open before it, and a class names what is not main text
only as a whole (``site-header``, not ``social-science``).

Defined results: null html is empty; null or odd URLs belong to the host ""; repeated
rows give equal rows, whatever their ids; a null ``page_id`` is passed on; pages equally
near to both neighbours take the one before; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as refs
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import range_parted
from .workspace import Workspace

#: Elements whose content is never main text.
DROPPED = frozenset("nav header footer aside form script style noscript template head title button select textarea input label svg math iframe object embed canvas audio video map dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Words in class, id or role that mark what is not main text.
NOT_MAIN = frozenset("ad ads advert adverts advertisement advertising banner sponsored sponsor promo comments comment discussion disqus respond replies sidebar nav navbar navigation menu breadcrumb breadcrumbs header footer masthead notice notices cookie cookies consent gdpr newsletter subscribe subscription signup popup modal share sharing social related recommended login search complementary contentinfo".split())
#: Words that may stand beside one of those in a name and change nothing: ``site-header``, ``ad-slot-2``.
NEUTRAL = frozenset("site page main top bottom left right center item items list box bar slot area section wrapper wrap container block button buttons link links primary secondary global widget inner outer content toggle panel row col group icon icons head body js".split())
#: Elements that are what they are, whatever they are called.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# A quote opens a value only behind "="; elsewhere it is a character.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*)>", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


def _names(word: str) -> bool:
    """Whether a whole name marks what is not main text: all of its parts are of NOT_MAIN, neutral or numbers, and one of NOT_MAIN; single letters are neutral."""
    parts = [p for p in re.split(r"[_-]+", word) if p]
    return any(p in NOT_MAIN for p in parts) and all(p in NOT_MAIN or p in NEUTRAL or len(p) == 1 or p[:1].isdigit() for p in parts)


def _not_main(attrs: str) -> bool:
    return any(_names(w) for m in ATTRIBUTE.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").lower().split())


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of a page's lines in order; kind 2: in article or main, 1: elsewhere, 0: not main text by its mark-up."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    kind = 1
    inside = 0  # open article or main elements
    dropped: str | None = None  # the element that is being dropped, and its depth
    depth = 0
    seen = False  # whether an article or main element came that was not dropped
    ends: dict[str, int] = {}  # the last end of an element's name

    def closed_later(name: str) -> bool:
        if name not in ends:
            ends[name] = max((m.start() for m in re.finditer(rf"</{name}\b", page, re.I)), default=-1)
        return ends[name] > at

    def close() -> None:
        line = SPACE.sub(" ", refs.unescape("".join(text))).strip()
        if line:
            out.append((line, kind))
        text.clear()

    page, at = page or "", 0
    while True:
        m = TAG.search(page, at)
        text.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            text.append(refs.escape(m["cdata"]))
        if m["name"] is None:
            continue
        name, ending, attrs = m["name"].lower(), bool(m["close"]), m["attrs"]
        alone = name in VOID or attrs.endswith("/")
        if name in INLINE and name != dropped and (ending or alone or not attrs or not _not_main(attrs)):
            continue
        close()
        if not ending and name in RAW:
            found = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = found.end() if found else len(page)
            continue
        if dropped and name in MAIN and not ending and not seen and not _not_main(attrs) and not (dropped in DROPPED and closed_later(dropped)):
            dropped, depth = None, 0  # what was left open before the article does not take it along
        if dropped:
            if name == dropped:
                depth += -1 if ending else not alone
            if depth == 0 or (dropped == "p" and not ending and name not in INLINE and name not in VOID and name != "p"):
                dropped = None
            elif dropped == "p" and name == "p" and not ending:  # a paragraph ends where the next begins
                depth, dropped = 0, None
        if not dropped and not ending and not alone and name not in ("html", "body", *MAIN) and (name in DROPPED or (name not in HEADINGS and _not_main(attrs))):
            dropped, depth = name, 1
        elif not dropped and name in MAIN:
            inside, seen = max(0, inside + (-1 if ending else 1)), True
        kind = 0 if dropped else 2 if inside else 1
    close()
    return out


#: Bits that an alignment may hold; above them it is cut in halves.
BITS = 1 << 23


def _row(a: list, b: list) -> int:
    """The last row of bit vectors: bit j is unset where b[j] adds one to the longest common subsequence of ``a`` and b[: j + 1]."""
    where: dict = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    v = full = (1 << len(b)) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with b[:0], b[:1], ... b."""
    bits = np.unpackbits(np.frombuffer(_row(a, b).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends are taken off, and what neither side knows; the rest is aligned by bit vectors
    over ``b``, or where those are many, by halves that meet where the sum of lengths is greatest,
    so memory grows with the lines and not with their product.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    known = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    places = [i for i in range(start, len(a) - end) if a[i] in known]
    theirs = [x for x in b[start : len(b) - end] if x in known]
    out, todo = [], [(0, len(places), 0, len(theirs))]
    mine = [a[i] for i in places]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        if (k - i) * (m - j) <= BITS or k - i == 1:
            out += [places[i + x] for x in _aligned(mine[i:k], theirs[j:m])]
            continue
        mid = (i + k) // 2
        cut = j + int(np.argmax(_lengths(mine[i:mid], theirs[j:m]) + _lengths(mine[mid:k][::-1], theirs[j:m][::-1])[::-1]))
        todo += [(i, mid, j, cut), (mid, k, cut, m)]
    return [*range(start), *sorted(out), *range(len(a) - end, len(a))]


def _aligned(a: list, b: list) -> list[int]:
    """Places in ``a``, with a row of bits for each of its lines."""
    where: dict = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [b.column(b.schema.get_field_index(c)) for c in ("key", "host", "path")]
        found = [[_hash(t) for t, _ in blocks(h)] for h in b.column(b.schema.get_field_index("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.list_(pa.int64()))], names=["key", "host", "path", "lines"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        theirs = b.column(2).to_pylist()
        found = [common(x, y or []) for x, y in zip(b.column(1).to_pylist(), theirs, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([y is not None for y in theirs], pa.bool_())], names=["key", "shared", "paired"])


def main_text(lines: list[tuple[str, int]], shared: list[int], paired: bool) -> str:
    """What is left of a page's lines when those shared with its pair are known."""
    gone, marked = set(shared), any(k == 2 for _, k in lines)
    rest = [t for n, (t, k) in enumerate(lines) if k == 2 or (k == 1 and n not in gone and (paired or not marked))]
    return " ".join(rest or [t for t, k in lines if k > 0])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("t", pa.string()), ("k", pa.int8())]))
    for b in batches:
        keep = [b.column(b.schema.get_field_index(c)) for c in ("key", "page_id", "url")]
        rows = [[{"t": t if k else "", "k": k} for t, k in blocks(h)] for h in b.column(b.schema.get_field_index("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(rows, kind)], names=["key", "page_id", "url", "lines"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lines", "shared", "paired")]
        texts = [main_text([(x["t"], x["k"]) for x in lines], shared or [], bool(paired)) for lines, shared, paired in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def nearest(keys: DataFrame, ws: Workspace) -> DataFrame:
    """(key, other): the neighbour in (host, path) order with the longer common beginning of the path."""
    order = ("host", "path", "key")
    parted = range_parted(keys.select(*order), ws, "ordered", *order)
    row = F.struct(*order)
    ends = parted.groupBy("_part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    by_part = Window.orderBy("_part")  # a row for each partition
    ends = ends.select("_part", F.lag("last").over(by_part).alias("before_part"), F.lead("first").over(by_part).alias("after_part"))
    inside = Window.partitionBy("_part").orderBy(*order)
    both = parted.withColumn("row", row).withColumn("before", F.lag("row").over(inside)).withColumn("after", F.lead("row").over(inside)).join(F.broadcast(ends), "_part")
    both = both.select("host", "path", "key", F.coalesce("before", "before_part").alias("before"), F.coalesce("after", "after_part").alias("after"))

    def like(other: str):
        same = F.zip_with(F.split("path", ""), F.split(F.col(f"{other}.path"), ""), lambda x, y: x.eqNullSafe(y))
        differs = F.array_position(same, False)  # the first place, from 1; 0 for equal paths
        alike = F.when(differs > 0, differs - 1).otherwise(F.length("path"))
        return F.when(F.col(f"{other}.host") == F.col("host"), alike).otherwise(-1)

    both = both.withColumn("b", like("before")).withColumn("a", like("after"))
    return both.select("key", F.when((F.col("b") >= F.col("a")) & (F.col("b") >= 0), F.col("before.key")).when(F.col("a") >= 0, F.col("after.key")).alias("other"))


def extract(pages: DataFrame, ws: Workspace) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A page is parsed once for its lines' hashes, which are compared, and once for its text.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    whole = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("page_id", "url", "html")))
    rows = rows.withColumn("key", F.unhex(F.md5(whole)))
    address = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)"
    host, path = F.coalesce(F.lower(F.regexp_extract("url", address, 1)), F.lit("")), F.coalesce(F.regexp_extract("url", address, 2), F.lit(""))
    lined = rows.select("key", host.alias("host"), path.alias("path"), "html").mapInArrow(_lines, "key binary, host string, path string, lines array<long>")
    lines = ws.save(lined.dropDuplicates(["key"]), "lines")
    pairs = nearest(lines, ws)
    theirs = lines.select(F.col("key").alias("other"), F.col("lines").alias("theirs"))
    found = lines.select("key", "lines").join(pairs, "key").join(theirs, "other", "left").select("key", "lines", "theirs").mapInArrow(_shared, "key binary, shared array<int>, paired boolean")
    shared = ws.save(found, "shared")
    ws.drop("lines")
    ws.drop("ordered")
    parsed = rows.select("key", "page_id", "url", "html").mapInArrow(_parsed, "key binary, page_id long, url string, lines array<struct<t: string, k: tinyint>>")
    # the same join at every size: a row for each page is not small
    return parsed.join(shared.hint("merge"), "key", "left").select("page_id", "url", "lines", "shared", "paired").mapInArrow(_finished, "page_id long, url string, text string, n_chars long")

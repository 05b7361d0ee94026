"""Divergence of sources by their words, through a frequent-pattern tree of term rows (operator 12).

Each language keeps the terms that at least ``LEAST`` of its documents hold. A source gives
every kept term the weight p = 1 + floor(10^9 (count + 5) / (N + 5 V)); two sources
differ by the sum of the differences of their weights, a source and its language by terms.

A source's weight without the term, p0, is its least, so of two sources with p0 <= r0 the
sum of the lesser weights is known where the first lacks the term (p0), and where the
second lacks it (the lesser of p and r0, from the first one's histogram of weights). Only
terms that both have need a correction, min(p, r) - min(p, r0). A term is a row of
its (source, weight) pairs in the order of sources; equal rows are one with a multiplicity; rows
in lexicographic order are a tree whose paths share their beginnings, and each node gives
its correction with each of its ancestors once, times the rows below it. Range partitions of
the rows are such trees; their sums add up. Sum of differences = sums of weights less twice the
sum of the lesser ones. All numbers are whole.

Words are counted in tasks, in tables that are sent on when they are full, so a word that all
documents share is a row for each table and source, and a source with a third of all
documents is counted where they lie. The result has a row for each ordered pair of a language's
sources, as asked; nothing else grows with their square.

Defined results: null texts, languages and sources are empty; repeated documents count as
often as they come; a group without terms differs by its smoothing alone; without kept
terms pairs differ by 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import runs_of
from .workspace import Workspace

LEAST, SHOWN, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
#: Entries and bytes of text after which a task's counts are sent on.
ENTRIES, BYTES = 300_000, 128_000_000
#: Bytes of one text that are split at once.
PIECE = 4_000_000
#: Corrections that a task holds before it adds them up.
HELD = 1_000_000

#: Every byte that is no part of a term becomes a space: ASCII but letters.
_APART = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size. Letters beyond ASCII stay as they are."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_APART)
        if end < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):  # one very long term
                end += PIECE
                more = text[end - PIECE : end].translate(_APART)
                cut = more.find(b" ")
                piece += more
                cut = len(piece) - len(more) + cut if cut >= 0 else -1
            if cut >= 0 and end < len(text):
                piece = piece[:cut]
                end = at + cut + 1
        at = end
        yield piece.lower().split()


COUNTED = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "count": pa.int64(), "docs": pa.int64()}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (words, docs) in counts.items():
            names = list(words)
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                cols = ([lang] * len(some), [source] * len(some), pa.array(some, pa.binary()).cast(pa.string()), [words[w] for w in some], [docs[w] for w in some])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, COUNTED.values(), strict=True)], names=list(COUNTED))
        counts.clear()

    for b in batches:
        langs, sources = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lang", "source"))
        for at, stop, texts in runs_of(b.column(b.schema.get_field_index("text"))):
            for lang, source, text in zip(langs[at:stop], sources[at:stop], texts, strict=True):
                if not text:
                    continue
                words, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for some in terms_of(text):
                    words.update(some)
                    own.update(some)
                docs.update(own)
                size += len(text)
            if size > BYTES or sum(len(w) for w, _ in counts.values()) > ENTRIES:
                yield from sent()
                size = 0
    yield from sent()


def term_rows(docs: DataFrame, ws: Workspace, least: int) -> DataFrame:
    """(lang, term, total, counts): the kept terms with their counts by source; written."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    counted = read.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    # counts of a term meet once: sums by source and then by term need no further shuffle
    dealt = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = dealt.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("counts"))
    return ws.save(whole.where(F.col("docs") >= least).select("lang", "term", "total", "counts"), "terms")


def weight(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)); 1 where there are no terms. Decimals, as the product passes 64 bits."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    below = F.nullif(n + v * SMOOTH, F.lit(0)).cast("decimal(20,0)")
    return 1 + F.coalesce(F.call_function("div", above, below), F.lit(0)).cast("long")


# ---- the tree


class Corrections:
    """Sums by pair of sources, held as arrays and added up when there are many."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def add(self, source: int, others: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(others + (source << 32))
        self.values.append(values)
        self.held += len(others)
        if self.held > 2 * HELD:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        values = np.zeros(len(keys), np.int64)
        np.add.at(values, at, np.concatenate(self.values))
        self.keys, self.values, self.held = [keys], [values], len(keys)
        return keys, values


class Tree:
    """The path of the row that came last; its earlier branches are already summed up, since rows come in order."""

    def __init__(self) -> None:
        self.path: list[tuple[int, int, int]] = []
        self.rows: list[int] = []
        self.sources, self.weights, self.bases = (np.zeros(64, np.int64) for _ in range(3))
        self.sums = Corrections()

    def insert(self, row: list[tuple[int, int, int]], multiplicity: int) -> None:
        same = 0
        while same < len(row) and same < len(self.path) and row[same] == self.path[same]:
            same += 1
        self.close(same)
        for node in row[same:]:
            depth = len(self.path)
            if depth == len(self.sources):
                self.sources, self.weights, self.bases = (np.concatenate([a, np.zeros_like(a)]) for a in (self.sources, self.weights, self.bases))
            self.sources[depth], self.weights[depth], self.bases[depth] = node
            self.path.append(node)
            self.rows.append(0)
        if self.rows:
            self.rows[-1] += multiplicity

    def close(self, depth: int = 0) -> None:
        """Leave the nodes below a depth: each meets its ancestors once, for all rows that went through it."""
        while len(self.path) > depth:
            source, p, base = self.path.pop()
            n, d = self.rows.pop(), len(self.path)
            if d:
                self.rows[-1] += n
                weights, bases = self.weights[:d], self.bases[:d]
                lesser = np.minimum(weights, p)
                # the side with the lesser base is the first one
                lacking = np.where((bases < base) | ((bases == base) & (self.sources[:d] < source)), np.minimum(weights, base), np.minimum(p, bases))
                self.sums.add(source, self.sources[:d], (lesser - lacking) * n)


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections by (lang, source, earlier source) of rows that come in order."""
    lang, tree = None, Tree()

    def sent() -> pa.RecordBatch:
        tree.close()
        keys, values = tree.sums.reduce()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys >> 32, pa.int64()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(values, pa.int64())], names=["lang", "x", "y", "more"])

    for b in batches:
        langs, n = b.column(0).to_pylist(), b.column(2).to_pylist()
        lists = b.column(1)
        ends = lists.offsets.to_numpy()
        flat = [lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
        for k in range(len(langs)):
            if langs[k] != lang or tree.sums.held > HELD:
                yield sent()
                if langs[k] != lang:
                    lang = langs[k]
                tree = Tree()
            tree.insert(list(zip(*(f[ends[k] : ends[k + 1]].tolist() for f in flat), strict=True)), n[k])
    yield sent()


# ---- the audit


def audit(docs: DataFrame, ws: Workspace, least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and the terms it has more of than its language."""
    terms = term_rows(docs, ws, least)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct()
    each = terms.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.count")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    sizes = each.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("held"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    known = groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").select("lang", "source", number.cast("long").alias("x"), *(zero(c).alias(c) for c in ("v", "n_lang", "n", "held")))
    known = ws.save(known.withColumn("p0", weight(F.lit(0), F.col("n"), F.col("v"))), "groups")

    weighed = each.join(known.select("lang", "source", "x", "n", "v", "n_lang", "p0"), ["lang", "source"])
    weighed = ws.save(weighed.select("lang", "source", "term", "x", "p0", weight(F.col("count"), F.col("n"), F.col("v")).alias("p"), weight(F.col("total"), F.col("n_lang"), F.col("v")).alias("q")), "weights")

    top = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = weighed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_term = more.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= shown)

    rows = weighed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("x", "p", "p0"))).alias("row"))
    rows = ws.save(rows.groupBy("lang", "row").agg(F.count("*").alias("n")).where(F.size("row") > 1), "rows")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("lang", "row", "n").repartitionByRange(parts, "lang", "row").sortWithinPartitions("lang", "row")
    joint = ordered.mapInArrow(_tree, "lang string, x long, y long, more long").groupBy("lang", F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).agg(F.sum("more").alias("more"))

    shared = known.select("lang", "x", "source", "p0", "v", "held")
    sums = weighed.groupBy("lang", "x").agg(F.sum("p").alias("p"))
    total = shared.join(sums, ["lang", "x"], "left").withColumn("all", zero("p") + (F.col("v") - F.col("held")) * F.col("p0")).drop("p")
    left = total.select("lang", *(F.col(c).alias(f"a_{c}") for c in ("x", "source", "p0", "v", "held", "all")))
    right = total.select("lang", *(F.col(c).alias(f"b_{c}") for c in ("x", "source", "p0", "all")))
    # the result has these pairs: every two sources of a language
    pairs = left.join(right, "lang").where("a_p0 < b_p0 OR (a_p0 = b_p0 AND a_x < b_x)")
    # lesser of the first one's weights and the other's base, over the terms that the first has
    bars = known.select("lang", "p0").distinct()
    asked = known.select("lang", "x", F.col("p0").alias("own")).join(bars, "lang").where("p0 >= own").select("lang", "x", F.col("p0").alias("p"), F.lit(0).alias("n"), F.lit(True).alias("asked"))
    points = weighed.groupBy("lang", "x", "p").agg(F.count("*").alias("n")).withColumn("asked", F.lit(False)).unionByName(asked)
    below = Window.partitionBy("lang", "x").orderBy("p", "asked").rowsBetween(Window.unboundedPreceding, 0)
    under = points.select("lang", "x", "p", "asked", F.sum("n").over(below).alias("cnt"), F.sum(F.col("n") * F.col("p")).over(below).alias("sum")).where("asked")
    under = under.select("lang", F.col("x").alias("a_x"), F.col("p").alias("b_p0"), "cnt", "sum")

    met = pairs.join(under, ["lang", "a_x", "b_p0"]).withColumns({"x": F.greatest("a_x", "b_x"), "y": F.least("a_x", "b_x")}).join(joint, ["lang", "x", "y"], "left")
    lesser = (F.col("a_v") - F.col("a_held")) * F.col("a_p0") + F.col("sum") + (F.col("a_held") - F.col("cnt")) * F.col("b_p0") + zero("more")
    value = met.withColumn("value", F.col("a_all") + F.col("b_all") - 2 * lesser)
    sides = F.explode(F.array(*(F.struct(F.col(f"{s}_source").alias("source"), F.col(f"{o}_source").alias("item")) for s, o in ("ab", "ba"))))
    by_pair = value.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(top))
    return by_pair.unionByName(by_term).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


#: The same audit in SQL, pair by pair and term by term.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (gn.n::HUGEINT + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n::HUGEINT + 5 * v.v) AS q FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item) UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 50
"""

"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

Which documents hold a benchmark item? An item with n distinct five-word shingles is
held when at least ``needed(n)`` = ceil(0.75 n) of them are in the document. Items
are partitioned by size, a partition for each power of two (and for each number of words
under five), with a table of its own. An item's sketch is a bottom-k MinHash: its
n - needed(n) + 1 least shingle hashes. A document that holds the item lacks at most
n - needed(n) of its shingles, so it has at least one of the sketch: the search misses
nothing, however long the document is. A partition whose least item needs more shingles than a
document has is not looked up. Candidates are confirmed by exact containment of whole
shingle sets.

The sketches and item sets go to the tasks as sorted arrays of bounded size: items are
taken in slices of at most ``SLICE_WORDS`` words, about 16 bytes each in every worker. A
benchmark of more than one slice makes a pass over the documents for each.

Defined results: items without words are held by none, and rows with a null ``item_id``
are no items; under five words the whole sequence is the one shingle, matched in
documents by that many consecutive words; repeated ``item_id``s are items of their own,
and a pair is given once with its best containment; documents are told apart by
``doc_id``, null included, so a repeated one gives a pair once; null and empty texts hold
nothing; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import runs_of, texts_of
from .words import SHINGLE, shingle_set, shingles, word_hashes, words_of
from .workspace import Workspace, bounded_batches

NUMERATOR, DENOMINATOR = 75, 100
SLICE_WORDS = 2_000_000
SCHEMA = "doc_id long, item_id long, n_item_shingles int, n_shared int"


def needed(n: int) -> int:
    """The least number of an item's n shingles that counts as holding it."""
    return -(-NUMERATOR * n // DENOMINATOR)


class Index:
    """Items' sets in one array, and for each partition by width and size the sketched hashes, sorted, each beside its item."""

    BITS = 22

    def __init__(self, items: list[tuple[int, bytes]]):
        sets = [(item_id, min(SHINGLE, len(words_of(text))), shingle_set(text)) for item_id, text in items]
        sets = [s for s in sets if len(s[2])]
        self.ids = [s[0] for s in sets]
        self.ends = np.cumsum([0, *(len(s[2]) for s in sets)])
        self.flat = np.concatenate([s[2] for s in sets]) if sets else np.zeros(0, np.uint64)
        parts: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for k, (_, width, own) in enumerate(sets):
            # sets are sorted and hashes are uniform: the first ones are a MinHash sketch
            parts.setdefault((width, len(own).bit_length()), []).append((own[: len(own) - needed(len(own)) + 1], k))
        least = lambda some: min(needed(len(sets[k][2])) for _, k in some)
        self.parts = [(width, least(some), *self._table(some)) for (width, _), some in sorted(parts.items())]

    def _table(self, own: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.concatenate([first for first, _ in own])
        item = np.repeat(np.array([k for _, k in own], np.int32), [len(first) for first, _ in own])
        order = np.argsort(keys, kind="stable")
        # a bit for each low part of a sketched hash: most shingles end here
        bits = np.zeros(1 << self.BITS, bool)  # a few partitions of four megabytes
        bits[(keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True
        return keys[order], item[order], bits

    def held(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item_id, size, shared) of the items that a document of these word hashes holds."""
        runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, least, keys, items, bits in self.parts:
            if len(words) - width + 1 < least:
                continue
            if width not in runs:
                own = np.unique(shingles(words, width))
                runs[width] = own, (own & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
            own, low = runs[width]
            maybe = own[bits[low]]
            lo, hi = np.searchsorted(keys, maybe), np.searchsorted(keys, maybe, side="right")
            if not (hi > lo).any():
                continue
            for k in np.unique(np.concatenate([items[a:b] for a, b in zip(lo, hi, strict=True) if b > a])).tolist():
                item = self.flat[self.ends[k] : self.ends[k + 1]]
                shared = len(np.intersect1d(item, own, assume_unique=True))
                if shared >= needed(len(item)):
                    yield self.ids[k], len(item), shared


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for keys, some in texts_of(batches, "doc_id"):
            rows = [(key, *hit) for key, text in zip(keys, some, strict=True) if text for hit in index.held(word_hashes(words_of(text)))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])

    return run


def _holds(shared):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        for column in columns:
            found = [bool(t) and next(index.held(word_hashes(words_of(t))), None) is not None for _, _, some in runs_of(column) for t in some]
            yield pa.array(found, pa.bool_())

    return F.arrow_udf(run, "boolean")


def slices(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's items, of at most SLICE_WORDS words (or one item) each, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").orderBy("item_id", "text")
    own, size = [], 0
    for r in items.toLocalIterator():
        text = (r["text"] or "").encode()
        own.append((r["item_id"], text))
        size += len(text.split())
        if size >= SLICE_WORDS:
            yield Index(own)
            own, size = [], 0
    if own:
        yield Index(own)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment): the pairs where the document holds the item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found, ws, before = spark.createDataFrame([], SCHEMA), None, None
    for k, index in enumerate(slices(benchmark)):
        if before is not None:  # several slices: the pass of each is written, so that its index can go
            ws = ws or Workspace(spark, "decontamination")
            found = found.unionByName(ws.save(before[0], f"slice-{k}"))
            before[1].destroy()
        shared = spark.sparkContext.broadcast(index)
        before = (texts.mapInArrow(_search(shared), SCHEMA), shared)
    found = found.unionByName(before[0]) if before is not None else found
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item_shingles")).alias("containment"), "n_item_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_shared", "b.containment")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns: decided row by row, whatever the ids; nothing is shuffled.

    With several slices the rows that each one leaves are written before the next, so one
    index is held at a time.
    """
    bounded_batches(docs.sparkSession)
    ws, before = None, None
    for k, index in enumerate(slices(benchmark)):
        if before is not None:
            ws = ws or Workspace(docs.sparkSession, "clean")
            docs = ws.save(docs, f"slice-{k}")
            before.destroy()
            if k > 1:
                ws.drop(f"slice-{k - 1}")
        before = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(~_holds(before)(F.col("text").cast("string")))
    return docs


#: The same pairs in SQL. Items under five words are looked for by their whole sequence.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
width AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d, width WHERE len(w) >= k),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM b, width WHERE k = least(len(w), 5)),
n AS (SELECT item_id, k, count(*) AS n FROM bs GROUP BY item_id, k),
m AS (SELECT doc_id, item_id, k, count(*) AS c FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id, k)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_item_shingles, CAST(c AS INTEGER) AS n_shared, CAST(c AS DOUBLE) / n AS containment
FROM m JOIN n USING (item_id, k) WHERE 100 * c >= 75 * n
"""

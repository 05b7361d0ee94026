"""Best-fit packing by minimum bin slack (operator 5).

Pieces of at most ``capacity`` ids go into sequences. What matters of a piece is
its length, so the plan is made from the histogram of lengths (at most
``capacity`` rows however large the corpus): take the longest length left, find by
bitset subset-sum dynamic programming over the available lengths the fullest
combination with it, and remove that combination as often as the counts allow.
The plan, a bounded table of intervals (length, rank -> sequence, offset), then
places the pieces in parallel by their rank among those of their length.

Defined results: null and empty texts have the end id only; repeated ``doc_id``s
are documents of their own; other columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoder, texts_of
from .workspace import Workspace

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, tail = encoder(path).ids, int(end).to_bytes(4, "little")
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length in this task so far
        part, step = TaskContext.get().partitionId(), 4 * capacity
        for keys, some in texts_of(batches, "doc_id"):
            rows: list[tuple] = []
            for key, text in zip(keys, some, strict=True):
                ids = to_ids(text) + tail
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    n = len(own) // 4
                    rows.append((key, k, at // 4, n, zlib.crc32(own), own if with_ids else None, part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def encode_pieces(docs: DataFrame, tokenizer: str, ws: Workspace, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Write (doc_id, piece, start, length, ids_crc32, ids, part, rank); documents over ``capacity`` are cut into pieces of it.

    ``rank`` counts the pieces of the same length before this one in its ``part``.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ws.save(rows.mapInArrow(_pieces(tokenizer, capacity, end, with_ids), PIECES), "pieces")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths (descending) with the largest sum within ``room``; long ones first."""
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, width, before = min(counts[length], room // length), 1, reach
        while left > 0:
            take = min(width, left)
            reach |= (reach << (take * length)) & mask
            left, width = left - take, width * 2
        layers.append((length, before))
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        used = 0
        while not before >> target & 1:  # the sum needs this length
            used, target = used + 1, target - length
        if used:
            chosen[length] = used
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, times) until no piece is left. Every step uses up a length or halves its count, so
    the number of steps is bounded by the lengths, not by the pieces."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    steps = []
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        counts[first] -= 1
        chosen = fullest(lengths, counts, capacity - first)
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        steps.append((chosen, times))
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return steps


def intervals(steps: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: pieces of a length by rank to places."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in steps:
        offset = 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                rows.append((length, used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0].astype(object) * (1 << 48) + table[:, 1] if len(table) else np.zeros(0)
        keys = keys.astype(np.int64)
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            row = table[k] if len(k) else np.zeros((0, 4), np.int64)
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces that ``encode_pieces`` wrote."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = intervals(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")


def sequences(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences of pieces with ids; a sequence holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))

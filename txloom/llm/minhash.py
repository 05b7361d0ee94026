"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures (operator 9).

A document's set holds its distinct five-word shingles. Its signature is 96
symbols of 16 bits, each from the least value of one hash function over the set.
The first 48 are split into 12 chunks of 4 symbols. Two signatures that differ there
in at most 23 symbols must, by the pigeonhole principle, have a chunk with at most one
differing symbol; so every chunk is indexed under its four patterns with one symbol
left out (the chunk errors allowed), and equal keys give every pair under that
distance. At similarity 0.75 a pair is missed with probability 1e-7. Found pairs
whose whole signatures differ in at most ``FAR`` symbols (at 0.75, all but 2 in a
million do) are confirmed on whole sets.

Copies of one set are one class. Groups are never expanded to all pairs: first each
member of a bucket is compared with the bucket's first class; then only members
still in different components are compared. Small buckets give their candidates;
large ones are dealt in tiles of bounded size that confirm candidates where they are,
nearest signatures first and none that confirmed links have joined already, and give
spanning links. A pair that shares several buckets is a candidate in the first only.

Defined results: null or empty texts and texts of white space have an empty set and
link with nothing; under five words the whole sequence is the one shingle; every row is
a document of its own, also under a repeated or null ``doc_id``, so rows of one id link
by their texts only; null ids come after all others: a group with an id goes by its
least, a group of null ids only has a null ``component_id`` and all its rows are kept by
the rule that equal ids are; other columns are ignored; an empty table gives none.
``deduplicated`` keeps one row of each group in any case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .encode import texts_of
from .words import mix, shingle_set
from .workspace import Workspace

SYMBOLS, INDEXED, CHUNK = 96, 48, 4
FAR = 44
#: Buckets of at most so many classes are compared whole in one pass.
SMALL = 128
NUMERATOR, DENOMINATOR = 75, 100
BLOCK = 512
#: Most rows of (id, digest of a text) that are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 500_000

_rng = np.random.Generator(np.random.PCG64(9))
FACTORS = _rng.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(values: np.ndarray) -> bytes:
    """96 symbols of 16 bits of a set of hashes; each factor is a bijection of 32-bit values."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (FACTORS[:, None] * x[at : at + 1024]).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def fingerprint(values: np.ndarray) -> bytes | None:
    """128 bits of a sorted set; none for an empty one."""
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, some in texts_of(batches, "doc_id"):
        sets = [shingle_set(t) for t in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([hashlib.md5(t or b"").digest() for t in some], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array([signature(x) if len(x) else None for x in sets], pa.binary())],
            names=["doc_id", "digest", "n_shingles", "fp", "sig"],
        )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mult, chunks = np.uint64(0x9E3779B97F4A7C15), INDEXED // CHUNK
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            sig = _matrix(part.column(1))[:, :INDEXED].astype(np.uint64).reshape(-1, chunks, CHUNK)
            keys = np.empty((len(sig), chunks, CHUNK), np.uint64)
            for out in range(CHUNK):
                h = np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(out + 1)
                h = np.broadcast_to(h, sig.shape[:2])
                for k in range(CHUNK):
                    if k != out:
                        h = h * mult + sig[:, :, k]
                keys[:, :, out] = mix(h)
            fp = part.column(0).take(pa.array(np.repeat(np.arange(len(sig)), INDEXED)))
            slot = pa.array(np.tile(np.arange(INDEXED, dtype=np.int8), len(sig)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), slot, fp], names=["key", "slot", "fp"])


def first_slot(same: np.ndarray) -> np.ndarray:
    """The first key that two signatures share, from their equal symbols (rows of booleans); they must share one."""
    chunks = same[:, :INDEXED].reshape(len(same), INDEXED // CHUNK, CHUNK)
    equal = chunks.sum(axis=2)
    first = (equal >= CHUNK - 1).argmax(axis=1)
    at = np.arange(len(same))
    return first * CHUNK + np.where(equal[at, first] == CHUNK, 0, chunks[at, first].argmin(axis=1))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep (a, b) with signatures at most FAR symbols apart."""
    for b in batches:
        away = (_matrix(b.column(2)) != _matrix(b.column(3))).sum(axis=1)
        keep = pa.array(away <= FAR)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, some in texts_of(batches, "doc_id"):
        sets = [shingle_set(t) for t in some]
        yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "items"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            x, y = ([np.frombuffer(v, np.uint64) for v in part.column(k).to_pylist()] for k in (2, 3))
            ok = pa.array([linked(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ok], names=["a", "b", "linked"])


def _halves(column) -> np.ndarray:
    """16-byte values as two numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


PAIRS = "a binary, b binary, d int"
BUCKET = ["key", "slot", "fp", "comp", "sig"]


def _pairs(fp, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([fp.take(pa.array(i)), fp.take(pa.array(j)), pa.array(d.astype(np.int32))], names=["a", "b", "d"])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the candidates within each bucket, for all buckets of a batch at once."""

    def within(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, slot, fp = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2)
        comp, sig = _halves(b.column(3)), _matrix(b.column(4))
        for k in range(1, SMALL):
            i = np.flatnonzero(key[k:] == key[:-k])
            if not len(i):
                break
            i = i[(comp[i] != comp[i + k]).any(axis=1)]
            for at in range(0, len(i), 50_000):
                p = i[at : at + 50_000]
                same = sig[p] == sig[p + k]
                d = SYMBOLS - same.sum(axis=1)
                near = np.flatnonzero(d <= FAR)
                near = near[first_slot(same[near]) == slot[p[near]]]
                if len(near):
                    yield _pairs(fp, p[near], p[near] + k, d[near])

    held: pa.Table | None = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = pa.concat_tables([held, table]) if held is not None else table
        key = np.asarray(table.column(0))
        whole = int(np.flatnonzero(key != key[-1])[-1] + 1) if len(key) and (key != key[-1]).any() else 0
        held = table.slice(whole)  # a small bucket may go on in the next batch
        for at in range(0, whole and 1):
            yield from within(table.slice(at, whole).combine_chunks().to_batches()[0])
    if held is not None and held.num_rows:
        yield from within(held.combine_chunks().to_batches()[0])


#: Bytes of shingle sets on each side of a tile.
TILE_BYTES = 48_000_000


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _large(table: pa.Table) -> pa.Table:
    """A block of a large bucket against some of its outsiders (classes not of its main component): spanning links."""
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    side = np.array(table.column("outsider").to_pylist(), bool)
    outside, block = np.flatnonzero(side), np.flatnonzero(~side)
    if not len(outside) or not len(block):
        return pa.Table.from_pylist([], schema=kind)
    slot = table.column("slot")[0].as_py()
    sig, comp = _matrix(table.column("sig")), _halves(table.column("comp"))
    parent = np.unique(comp.view([("x", np.uint64), ("y", np.uint64)]).reshape(-1), return_index=True, return_inverse=True)
    root = parent[1][parent[2]].tolist()  # the first row of a component stands for it
    sets, a, b = table.column("items"), [], []
    opened: dict[int, np.ndarray] = {}

    def items(k: int) -> np.ndarray:
        if k not in opened:
            opened[k] = np.frombuffer(sets[k].as_py(), np.uint64)
        return opened[k]

    for at in range(0, len(outside), 64):
        r = outside[at : at + 64]
        d = np.zeros((len(r), len(block)), np.int16)
        for k in range(SYMBOLS):
            d += sig[r, k][:, None] != sig[block, k][None, :]
        d[(comp[r][:, None, :] == comp[block][None, :, :]).all(axis=2)] = SYMBOLS + 1
        i, j = np.nonzero(d <= FAR)
        if not len(i):
            continue
        own = first_slot(sig[r[i]] == sig[block[j]]) == slot
        i, j = i[own], j[own]
        order = np.lexsort((d[i, j], i))
        for p, q in zip(r[i[order]].tolist(), block[j[order]].tolist(), strict=True):
            x, y = _find(root, p), _find(root, q)
            if x != y and linked(items(p), items(q)):
                root[max(x, y)] = min(x, y)
                a.append(p)
                b.append(q)
    fp = table.column("fp")
    return pa.table({"a": fp.take(pa.array(a, pa.int64())), "b": fp.take(pa.array(b, pa.int64()))}).cast(kind)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that still hold several components, with ``comp`` and the bucket's size ``n``."""
    named = rows.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("component", "fp")).drop("component")
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").cast("int").alias("n")).where("lo <> hi").select("key", "n")
    return named.join(mixed, "key")


def _tiles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between components of large buckets, confirmed."""
    # an item of a set is eight bytes
    by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum(F.col("n_items") * 8).alias("s"))
    # a tile is bounded by its rows and by the bytes of their sets
    cut = lambda n, rows_, s: F.ceil(F.greatest(n / rows_, s / TILE_BYTES)).cast("int")
    whole = by_comp.groupBy("key").agg(F.max(F.struct("c", "comp", "s")).alias("m"), F.sum("c").alias("n"), F.sum("s").alias("s"))
    main = whole.select("key", F.col("m.comp").alias("main"), cut(F.col("n"), BLOCK, F.col("s")).alias("blocks"), cut(F.col("n") - F.col("m.c"), 2 * BLOCK, F.col("s") - F.col("m.s")).alias("parts"))
    inside = rows.drop("n").join(main, "key").join(sets, "fp")
    number = F.xxhash64("fp", "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*BUCKET, "items", "block", "part"]
    plain = inside.withColumn("block", F.pmod(number, F.col("blocks")).cast("int")).withColumn("part", every("parts")).select(*columns, F.lit(False).alias("outsider"))
    outside = inside.where("comp <> main").withColumn("part", F.pmod(number, F.col("parts")).cast("int")).withColumn("block", every("blocks")).select(*columns, F.lit(True).alias("outsider"))
    return plain.unionByName(outside).groupBy("key", "block", "part").applyInArrow(_large, "a binary, b binary")


def _undone(found: DataFrame, done: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def _order():
    """Rows of a group in this order: the least has the least id, nulls last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")


def _rows_among(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest of the text) is among ``keys`` (left_semi), or isn't (left_anti)."""
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # the row is one struct, so no name of its columns matters
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("digest"))
    keys = keys.select(F.col("doc_id").alias("key_id"), F.col("digest").alias("key_digest"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("digest") == F.col("key_digest"))
    return own.join(keys, same, how).select("row.*")


def _grouped(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_shingles, label) for each row, a null label for empty sets; and (label, head), the least row of each label."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = ws.save(docs.mapInArrow(_signed, "doc_id long, digest binary, n_shingles long, fp binary, sig binary"), "signed")
    classes = signed.where("fp is not null").groupBy("fp").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n_items"), F.min(_order()).alias("one"))
    keys = classes.select("fp", "sig").mapInArrow(_keyed, "key long, slot byte, fp binary")
    first = keys.groupBy("key").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).where("lead <> last").drop("last")
    shared = ws.save(keys.join(first, "key"), "shared")
    known = ws.save(classes.join(shared.select("fp").distinct(), "fp", "left_semi"), "known")
    sigs = known.select("fp", "sig", "n_items")
    sets = _rows_among(docs, known.select("one.doc_id", "one.digest"), "left_semi").mapInArrow(_sets, "fp binary, items binary")
    sets = ws.save(sets.groupBy("fp").agg(F.first("items").alias("items")), "sets")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        one = sets.select(F.col("fp").alias("a"), F.col("items").alias("x"))
        two = sets.select(F.col("fp").alias("b"), F.col("items").alias("y"))
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
        return ws.save(both.mapInArrow(_confirmed, "a binary, b binary, linked boolean"), name)

    star = shared.where("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct()
    with_sig = star.join(sigs.select(F.col("fp").alias("a"), F.col("sig").alias("s")), "a").join(sigs.select(F.col("fp").alias("b"), F.col("sig").alias("t")), "b")
    done = confirm(with_sig.select("a", "b", "s", "t").mapInArrow(_near, "a binary, b binary"), "confirmed-0")
    links = done.where("linked").select("a", "b")
    # a first label for each class, by two steps to confirmed first classes: equal labels are connected
    lead = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("step"))
    labels = ws.save(lead.join(lead.select(F.col("id").alias("step"), F.col("step").alias("next")), "step", "left").select("id", F.coalesce("next", "step").alias("component")), "labels")
    rows = ws.save(_labelled(shared.select("key", "slot", "fp"), labels).join(sigs, "fp"), "mixed")
    small = rows.where(F.col("n") <= SMALL).select(*BUCKET).repartition("key").sortWithinPartitions("key").mapInArrow(_small, PAIRS)
    more = confirm(_undone(small, done), "confirmed-1").where("linked").select("a", "b")
    more = ws.save(more.unionByName(_tiles(rows.where(F.col("n") > SMALL), sets)), "more")
    labels = components(links.unionByName(more), ws)
    for name in ("shared", "sets", "mixed"):
        ws.drop(name)
    rows = signed.select("doc_id", "digest", "n_shingles", "fp").join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("doc_id", "digest", "n_shingles", F.coalesce("component", "fp").alias("label"))
    # written first, so that joins with it have plain exchanges, which adaptive execution splits at a hot component
    return rows, ws.save(rows.where("label is not null").groupBy("label").agg(F.min(_order()).alias("head")), "heads")


def near_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    rows, heads = _grouped(docs, ws)
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    out = rows.join(heads, "label", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one row of each group: that of the least id. Rows without words all stay."""
    rows, heads = _grouped(docs, ws)
    placed = ws.save(rows.join(heads, "label").select("doc_id", "digest", (_order() == F.col("head")).alias("least")), "placed")
    kept = _rows_among(docs, placed.where("not least").select("doc_id", "digest").distinct(), "left_anti")
    # the least row itself may be there several times
    repeated = placed.where("least").groupBy("doc_id", "digest").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    first = _rows_among(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return _rows_among(kept, repeated, "left_anti").unionByName(first)

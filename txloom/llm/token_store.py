"""Content-addressed store of token ids (operator 1).

``write`` encodes whole texts, cuts each document's id stream where a rolling
hash of the last 16 ids says so, and writes

* ``objects``: every distinct chunk once, under its 128-bit BLAKE2b digest;
* ``recipes``: in ascending ``doc_id`` order a row for each document: the place of
  its first id in the whole stream, its number of ids, the digests and lengths of
  its chunks and the Merkle root over the digests;
* ``manifest``: for each recipe partition the root of a Merkle tree whose leaves are
  the key, start, number of ids and Merkle root of its recipes, in order. A node has
  ``FAN`` children at most, so no task ever gathers a partition's recipes.

Equal passages give equal chunks, so copies cost a recipe only. ``verify`` reads
the files back, recomputes every digest and root, holds them against the recipes and
the manifest and gives each document's CRC; ``read`` rebuilds the id streams.

Defined results: a null or empty text has only the end id; repeated ``doc_id``s
are documents of their own, ordered by their Merkle root, and equal rows have a recipe
each; rows with a null ``doc_id`` come first; other columns are ignored; an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder, texts_of
from .ordering import range_parted, running_start
from .workspace import Workspace

END = 2
#: Children of a node of the manifest's trees.
FAN = 256
LEAST, MEAN_BITS, MOST = 256, 10, 4096
CUT_SCHEMA = "doc_id long, n_tokens long, root binary, chunks array<struct<digest: binary, n: int, ids: binary>>"

#: A 64-bit number for each id, by rule.
_rng = np.random.Generator(np.random.PCG64(7))
GEAR = _rng.integers(0, 2**63, 1 << 16, dtype=np.uint64)
MASK = np.uint64(((1 << MEAN_BITS) - 1) << 40)


def rolling(ids: np.ndarray) -> np.ndarray:
    """Gear hash of the last 16 ids at every place, by doubling."""
    h = GEAR[ids & 0xFFFF]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint64(width)
    return h


def cut_places(marks: np.ndarray, n: int) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids: the first mark past LEAST, MOST without one."""
    ends, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def digest_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd node goes up as it is."""
    while len(leaves) > 1:
        pairs = [digest_of(b"\x01" + b"".join(leaves[k : k + 2])) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        leaves = pairs
    return leaves[0] if leaves else digest_of(b"")


def _packed(ids: np.ndarray) -> bytes:
    """Stored form: 16-bit ids where all fit, else 32-bit behind a mark byte."""
    return ids.astype("<u2").tobytes() if int(ids.max(initial=0)) < 65536 else b"\xff" + ids.astype("<u4").tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2").astype("<u4") if len(stored) % 2 == 0 else np.frombuffer(stored, "<u4", offset=1)


def _cut(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, tail = encoder(path).ids, int(end).to_bytes(4, "little")
        for keys, some in texts_of(batches, "doc_id"):
            streams = [to_ids(t) + tail for t in some]
            flat = np.frombuffer(b"".join(streams), "<u4")
            marks = np.flatnonzero((rolling(flat.astype(np.int64)) & MASK) == 0) + 1
            n, root, at = [], [], 0
            digests, sizes, stored, first = [], [], [], [0]  # of all chunks; the first chunk of each document
            for s in streams:
                size = len(s) // 4
                lo, hi = np.searchsorted(marks, (at, at + size + 1))
                start = 0
                for stop in cut_places(marks[lo:hi] - at, size):
                    stored.append(_packed(flat[at + start : at + stop]))
                    digests.append(digest_of(stored[-1]))
                    sizes.append(stop - start)
                    start = stop
                n.append(size)
                root.append(merkle_root(digests[first[-1] :]))
                first.append(len(digests))
                at += size
            chunks = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(stored, pa.binary())], names=["digest", "n", "ids"])
            chunks = pa.ListArray.from_arrays(pa.array(first, pa.int32()), chunks)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.binary()), chunks], names=["doc_id", "n_tokens", "root", "chunks"])

    return run


def write(docs: DataFrame, tokenizer: str, ws: Workspace, end: int = END) -> None:
    """Encode ``docs`` (doc_id, text) and write the store into ``ws``."""
    cut = ws.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(tokenizer, end), CUT_SCHEMA), "cut")
    chunk = F.explode("chunks").alias("c")
    # copies meet before the shuffle already (partial aggregation), so a chunk of many documents is no hot key
    objects = cut.select(chunk).groupBy("c.digest").agg(F.first("c.n").alias("n"), F.first("c.ids").alias("ids"))
    ws.save(objects, "objects")
    recipes = cut.select("doc_id", "root", "n_tokens", F.transform("chunks", lambda c: c["digest"]).alias("digests"), F.transform("chunks", lambda c: c["n"]).alias("lengths"))
    parted = range_parted(recipes, ws, "parted", "doc_id", "root")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("doc_id", "root")) - 1
    started = running_start(parted.withColumn("place", place.cast("long")), "n_tokens", "doc_id", "root")
    ws.save(started.sortWithinPartitions("doc_id", "root", "place"), "recipes")
    ws.drop("cut")
    ws.drop("parted")
    ws.save(partition_roots(ws.spark.read.parquet(ws.of("recipes"))), "manifest")


def partition_roots(recipes: DataFrame) -> DataFrame:
    """(_part, n_docs, n_tokens, root): a row for each recipe partition, from its tree, level by level."""
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root")), 256)
    nodes = recipes.select("_part", "place", leaf.alias("root"), F.lit(1).cast("long").alias("n_docs"), "n_tokens")
    width = 1 + (recipes.agg(F.max("place")).first()[0] or 0)
    while True:
        children = F.array_sort(F.collect_list(F.struct("place", "root")))  # FAN of them at most
        joined = F.array_join(F.transform(children, lambda c: c["root"]), ",")
        nodes = nodes.groupBy("_part", F.floor(F.col("place") / FAN).alias("up")).agg(F.sha2(joined, 256).alias("root"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        nodes, width = nodes.withColumnRenamed("up", "place"), -(-width // FAN)
        if width <= 1:
            return nodes.select("_part", "n_docs", "n_tokens", "root")


# CRC of a whole from the CRCs of its parts: shifting by zero bytes is linear, so
# the whole's CRC is the exclusive or of each part's, shifted by the bytes behind it.


def _shift_tables() -> np.ndarray:
    """For k = 0..47: four tables of 256 that append 2^k zero bytes to a CRC."""
    one = np.zeros(32, np.uint64)  # images of single bits under one zero byte
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one[bit] = c
    tables = []
    for _ in range(48):
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        t = np.stack([np.bitwise_xor.reduce(np.where(bits == 1, one[8 * b : 8 * b + 8], 0).astype(np.uint64), axis=1) for b in range(4)])
        tables.append(t)
        one = _apply(t, one)
    return np.stack(tables)


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64)
    return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][(c >> 24) & 255]


SHIFT = _shift_tables()


def shifted_crc(crc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """CRC32 parts moved in front of ``behind`` bytes."""
    out = crc.astype(np.uint64)
    for k in range(int(behind.max(initial=0)).bit_length()):
        on = (behind >> k) & 1 == 1
        out[on] = _apply(SHIFT[k], out[on])
    return out


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digest, n, stored = (b.column(k).to_pylist() for k in range(3))
        ids = [unpacked(s) for s in stored]
        good = [digest_of(s) == d and len(x) == k for s, d, x, k in zip(stored, digest, ids, n, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(good, pa.bool_())], names=["digest", "n", "crc", "good"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to recipes whether the root and number of ids are those of the chunks, and the ids behind each chunk."""
    for b in batches:
        n, root, digests, lengths = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n_tokens", "root", "digests", "lengths"))
        whole = [len(d or ()) == len(m or ()) > 0 and None not in d and None not in m and merkle_root(d) == r and sum(m) == k for k, r, d, m in zip(n, root, digests, lengths, strict=True)]
        behind = [[*accumulate(reversed([x or 0 for x in m[1:]]), initial=0)][::-1] if m else [] for m in lengths]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(whole, pa.bool_()), pa.array(behind, pa.list_(pa.int64()))], names=[*b.schema.names, "whole", "behind"])


def _shift_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc, behind = (np.asarray(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)) for c in ("crc", "behind"))
        keep = [b.column(b.schema.get_field_index(c)) for c in ("_part", "doc_id", "start", "n_tokens", "good")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(shifted_crc(crc, behind * 4).astype(np.int64))], names=["_part", "doc_id", "start", "n_tokens", "good", "part"])


def verify(spark: SparkSession, ws: Workspace) -> DataFrame:
    """Read the store's files: (doc_id, start, n_tokens, ids_crc32, intact) for each document.

    A document is not intact when one of its objects is missing or changed, when its
    digests or lengths don't give its root and number of ids, or when its recipe partition
    isn't the one in the manifest. A partition of the manifest without recipes gives one
    row, not intact, with the ids lost as ``n_tokens`` and nulls. Chunks are read once
    each; a document's CRC comes from its chunks' by exclusive or, so no group of
    chunks meets in a task.
    """
    objects = spark.read.parquet(ws.of("objects")).select("digest", "n", "ids").mapInArrow(_checked, "digest binary, n int, crc long, good boolean")
    kept = spark.read.parquet(ws.of("recipes"))
    recipes = kept.select("_part", "doc_id", "start", "n_tokens", "root", "digests", "lengths").mapInArrow(_rooted, "_part int, doc_id long, start long, n_tokens long, root binary, digests array<binary>, lengths array<int>, whole boolean, behind array<long>")
    parts = recipes.select("_part", "doc_id", "start", "n_tokens", "whole", F.explode_outer(F.arrays_zip("digests", "lengths", "behind")).alias("c"))
    parts = parts.select("_part", "doc_id", "start", "n_tokens", "whole", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("length"), F.coalesce("c.behind", F.lit(0).cast("long")).alias("behind"))
    good = F.col("whole") & F.coalesce("good", F.lit(False)) & F.coalesce(F.col("n") == F.col("length"), F.lit(False))
    found = parts.join(objects, "digest", "left").select("_part", "doc_id", "start", "n_tokens", "behind", F.coalesce("crc", F.lit(0)).alias("crc"), good.alias("good"))
    shifted = found.mapInArrow(_shift_map, "_part int, doc_id long, start long, n_tokens long, good boolean, part long")
    docs = shifted.groupBy("_part", "doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"), F.every("good").alias("good"))
    # a row for each partition: bounded by the number of partitions
    listed = spark.read.parquet(ws.of("manifest")).select("_part", F.struct("n_docs", "n_tokens", "root").alias("said"))
    seen = partition_roots(kept).select("_part", F.struct("n_docs", "n_tokens", "root").alias("found"))
    agreed = listed.join(seen, "_part", "full_outer").select("_part", F.col("said").eqNullSafe(F.col("found")).alias("as_listed"), F.col("found").isNull().alias("lost"), F.col("said.n_tokens").alias("n_tokens"))
    checked = docs.join(F.broadcast(agreed.select("_part", "as_listed")), "_part", "left")
    checked = checked.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("good") & F.coalesce("as_listed", F.lit(False))).alias("intact"))
    none = F.lit(None).cast("long")
    return checked.unionByName(agreed.where("lost").select(none.alias("doc_id"), none.alias("start"), "n_tokens", none.alias("ids_crc32"), F.lit(False).alias("intact")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [b"".join(unpacked(x).tobytes() for x in row) for row in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, ws: Workspace) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the id streams, little-endian 32-bit, rebuilt from recipes and objects."""
    parts = spark.read.parquet(ws.of("recipes")).select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("k", "digest"))
    chunks = parts.join(spark.read.parquet(ws.of("objects")), "digest")
    rows = chunks.groupBy("doc_id", "start", "n_tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("parts"))
    return rows.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids binary")

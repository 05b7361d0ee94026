"""Quality classifier: random-indexing word vectors, pooled, into a small network (operator 4).

Every word piece falls into one of ``BUCKETS`` buckets by a hash of its lower-case
form; pieces in capitals also give a mark of their own, and runs of symbols and
numbers are pieces too. Each bucket has a fixed sparse index vector (four entries of
+-1 in ``DIMS``). A bucket's word vector is the sum, over all its occurrences in all
documents, of the index vectors of the two pieces on either side, scaled to length 1.
A document is the mean and the spread of its pieces' vectors; a network of two
layers, trained here with numpy on labelled rows, turns that into a logit, and a
temperature fitted on rows kept from training turns the logit into a probability.

Word vectors are sums of whole numbers, so they don't depend on the order of rows.

Defined results: null and empty texts have the zero vector and its score; repeated
rows and null ids get the score of their text; rows that tie in all their numbers train
in any order; without labels of both kinds every score is 0.5; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import runs_of, texts_of
from .labelled import SAMPLE, held_out, training_rows
from .words import kept
from .workspace import bounded_batches

BUCKETS, DIMS, ENTRIES = 1 << 14, 32, 4
REACH = 2
HIDDEN = 32
THRESHOLD = 0.5
BLOCK_ROWS = 512
CAPITALS, NUMBER = 0, 1
PIECES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")

_rng = np.random.Generator(np.random.PCG64(4))
PLACES = np.argsort(_rng.random((BUCKETS, DIMS)), axis=1)[:, :ENTRIES]
SIGNS = _rng.choice(np.array([-1.0, 1.0]), (BUCKETS, ENTRIES))


class Pieces(dict):
    """White-space-separated raw word -> buckets as bytes; emptied when full."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> bytes:
        out = []
        for p in PIECES.findall(word.decode("utf-8", "replace")):
            if p[0].isdigit():
                out.append(NUMBER)
                continue
            out.append(2 + xxhash.xxh3_64_intdigest(p.lower()) % (BUCKETS - 2))
            if len(p) > 1 and p.isupper():
                out.append(CAPITALS)
        value = np.array(out, "<i4").tobytes()
        if len(self) >= self.LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def joined(some: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all texts one after another, number for each text)."""
    piece = kept("pieces", Pieces).__getitem__
    parts = [b"".join(map(piece, t.split())) if t else b"" for t in some]
    return np.frombuffer(b"".join(parts), "<i4").astype(np.int64), np.array([len(p) // 4 for p in parts])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * DIMS)
    for _, some in texts_of(batches, "doc_id"):
        ids, sizes = joined(some)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for away in range(1, REACH + 1):
            same = owner[away:] == owner[:-away]
            left, right = ids[:-away][same], ids[away:][same]
            for word, near in ((left, right), (right, left)):
                for k in range(ENTRIES):
                    total += np.bincount(word * DIMS + PLACES[near, k], weights=SIGNS[near, k], minlength=BUCKETS * DIMS)
    if total.any():
        task = TaskContext.get().partitionId()
        blocks = total.astype("<i8").reshape(-1, BLOCK_ROWS * DIMS)
        small = "<i4" if np.abs(total).max() < 2**31 else "<i8"
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([task % 16] * len(blocks), pa.int32()), pa.array([b.astype(small).tobytes() for b in blocks], pa.binary())], names=["block", "salt", "sums"])


def _whole(stored: bytes) -> np.ndarray:
    """A block of sums, in 32 or 64 bits."""
    return np.frombuffer(stored, "<i4" if len(stored) == 4 * BLOCK_ROWS * DIMS else "<i8").astype(np.int64)


def _sum(table: pa.Table) -> pa.Table:
    sums = np.zeros(BLOCK_ROWS * DIMS, np.int64)
    for b in table.column("sums"):
        sums += _whole(b.as_py())
    return pa.table({"block": table.column("block")[:1], "salt": table.column("salt")[:1], "sums": pa.array([sums.astype("<i8").tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The (BUCKETS, DIMS) table from all documents; tasks' sums are added in two rounds of small groups."""
    kind = "block int, salt int, sums binary"
    sums = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_contexts, kind)
    for keys in (["block", "salt"], ["block"]):
        sums = sums.groupBy(*keys).applyInArrow(_sum, kind)
    table = np.zeros((BUCKETS, DIMS))
    for r in sums.collect():  # of a fixed size
        table[r["block"] * BLOCK_ROWS : (r["block"] + 1) * BLOCK_ROWS] = _whole(r["sums"]).reshape(-1, DIMS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


#: Pieces of a text whose vectors are held at once, however long it is.
AT_ONCE = 65_536


def pooled(table: np.ndarray, some: list[bytes | None]) -> np.ndarray:
    """Mean and spread of the pieces' vectors of each text."""
    ids, sizes = joined(some)
    out = np.zeros((len(some), 2 * DIMS))
    ends = np.cumsum(sizes)
    for k, (end, n) in enumerate(zip(ends, sizes, strict=True)):
        if n:
            own = [ids[at : min(at + AT_ONCE, end)] for at in range(end - n, end, AT_ONCE)]
            mean = sum(table[i].sum(axis=0, dtype=np.float64) for i in own) / n
            out[k, :DIMS] = mean
            out[k, DIMS:] = np.sqrt(sum(((table[i] - mean) ** 2).sum(axis=0) for i in own) / n)
    return out


@dataclass
class Model:
    table: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(x))
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 1e-4) -> tuple:
    """Two layers by Adam on whole batches."""
    rng = np.random.Generator(np.random.PCG64(44))
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for t in range(1, steps + 1):
        h = np.tanh(x @ w[0] + w[1])
        p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40)))
        d = (p - y) / len(y)
        back = np.outer(d, w[2]) * (1 - h**2)
        grads = [x.T @ back + decay * w[0], back.sum(axis=0), h.T @ d + decay * w[2], d.sum(keepdims=True)]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w[0], w[1], w[2], float(w[3][0])


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    tries = np.exp(np.linspace(np.log(0.2), np.log(8), 80))
    z = logits[None, :] / tries[:, None]
    loss = (np.logaddexp(0, z) - z * y).mean(axis=1)
    return float(tries[int(loss.argmin())])


def _pool(shared, keep: str, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for keys, some in texts_of(batches, keep):
            x = pooled(table, some).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Word vectors from all documents; the network from labelled ones that are not held out."""
    bounded_batches(docs.sparkSession)
    table = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = training_rows(docs, labels, "quality", most).select("label", "text").mapInArrow(_pool(shared, "label", pa.int32()), "label int, x binary").toPandas()
    model = Model(table, np.zeros(2 * DIMS), np.ones(2 * DIMS))
    y = rows.label.to_numpy(float)
    if len(set(y)) < 2:
        return model
    # the order of rows from a cluster is open: sort, so that a fit is repeatable
    order = sorted(range(len(y)), key=lambda k: (y[k], rows.x[k]))
    x, y = np.frombuffer(b"".join(rows.x[k] for k in order), "<f4").reshape(-1, 2 * DIMS).astype(float), y[order]
    model.shift, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - model.shift) / model.scale
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[aside])) == 2 and len(set(y[~aside])) == 2:
        model.layers = train(z[~aside], y[~aside])
        model.temperature = temperature(model.logits(x[aside]), y[aside])
    else:
        model.layers = train(z, y)
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for keys, some in texts_of(batches, "doc_id"):
            p = model.probabilities(pooled(model.table, some).astype("<f4").astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(p)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scored(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _probability(shared):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in columns:
            found = [model.probabilities(pooled(model.table, some).astype("<f4").astype(float)) for _, _, some in runs_of(column)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are predicted of quality, with all their columns; nothing is shuffled.

    Only texts go to Python, and only numbers come back.
    """
    p = _probability(docs.sparkSession.sparkContext.broadcast(model))(F.col("text").cast("string"))
    return docs.where(p >= THRESHOLD)

"""Toxic passages by maximum-scoring segment search (operator 8).

A token's score is its log-odds between toxic and other training documents under an
informative Dirichlet prior (the token's overall share, as strong as the toxic
documents' own tokens), kept where it is significant, less a small drift. Tokens are
words and the beginnings of words, counted once for each document; a word takes its
best token, and a word without any scores the drift alone. One linear scan
(Ruzzo and Tompa) finds every maximal-scoring passage of a text. Scores are made
comparable across lengths by extreme-value statistics (Karlin and Altschul): lambda
solves sum p exp(lambda s) = 1 over ordinary words, K is fitted on ordinary
documents; a passage of score S in n words has normalized score lambda S - ln(K n).
A logistic curve over the best and the summed significant scores gives the probability.
K and the curve are fitted on a fifth of the labelled documents whose tokens were not
counted, where that fifth has both kinds.

Defined results: null and empty texts have no words and get the score of a document
without any passage; repeated rows and null ids get the score of their text; without
labels of both kinds every score is 0; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import runs_of, texts_of
from .labelled import SAMPLE, held_out, training_rows
from .workspace import Workspace

THRESHOLD = 0.7
LEAST_DOCS = 4
LEAST_Z = 3.5
LEAST_ODDS = 1.5
DRIFT = 0.1
STEMS = range(4, 10)
MARKS = " .,;:!?\"'()[]{}<>*-_#$%&|/\\~`«»“”„’"


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    k: float = 0.1
    weights: tuple[float, ...] | None = None  # of 1, best, summed


def normal(word: bytes) -> str:
    text = word.decode("utf-8", "replace").lower()
    return text.strip(MARKS) or text


def tokens(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *(word[:n] + "~" for n in STEMS if n < len(word))]


class WordScores(dict):
    """Raw word -> score; emptied when full."""

    LIMIT = 200_000

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.known = scores

    def __missing__(self, word: bytes) -> float:
        value = max((self.known.get(t, 0.0) for t in tokens(normal(word)))) - DRIFT
        if len(self) >= self.LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score), in linear time.

    Only words with a positive score are visited; what lies between is one sum.
    """
    ups = np.flatnonzero(scores > 0)
    if not len(ups):
        return []
    total = np.cumsum(scores, dtype=np.float64)
    found: list[list] = []  # begin, end, sum before, sum at the end, nearest earlier one with a lower sum before
    for at in ups.tolist():
        right = float(total[at])
        begin, left = at, right - float(scores[at])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([begin, at + 1, left, right, j])
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in found]


def features(model: Model, scores: np.ndarray) -> tuple[float, float]:
    """Best and summed significant normalized passage scores."""
    offset = math.log(max(model.k * max(len(scores), 1), 1e-9))
    values = [model.rate * s - offset for _, _, s in segments(scores)]
    return max(values, default=-offset if offset > 0 else 0.0), math.log1p(sum(v for v in values if v > 0))


def probability(model: Model, best: float, total: float) -> float:
    if model.weights is None:
        return 0.0
    z = model.weights[0] + model.weights[1] * best + model.weights[2] * total
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, label, documents) of each run of texts."""
    for label, some in texts_of(batches, "label"):
        docs: list[Counter] = [Counter(), Counter()]
        for k, text in zip(label, some, strict=True):
            docs[k].update({t for w in set((text or b"").split()) for t in tokens(normal(w))})
        rows = [(t, k, c) for k in (0, 1) for t, c in docs[k].items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["token", "label", "docs"])


def log_odds(y1: float, y0: float, n1: float, n0: float) -> tuple[float, float]:
    """(log-odds, z) of a token counted y1 of n1 and y0 of n0 times; the prior weighs as much as n1 counts."""
    a = n1 * (y1 + y0) / (n1 + n0)
    d = math.log((y1 + a) / (2 * n1 - y1 - a)) - math.log((y0 + a) / (n0 + n1 - y0 - a))
    return d, d / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = WordScores(model.scores)
        for label, some in texts_of(batches, "label"):
            best, total, top, n = [], [], [], []
            for text in some:
                words = (text or b"").split()
                s = np.fromiter(map(table.__getitem__, words), np.float64, len(words))
                x, y = features(model, s)
                best.append(x)
                total.append(y)
                top.append(max((v for _, _, v in segments(s)), default=0.0))
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(top, pa.float64()), pa.array(n, pa.int64())], names=["label", "best", "total", "top", "n"])

    return run


def _solve_rate(parts: list[tuple[float, float]]) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1."""
    if not any(s > 0 for s, _ in parts):
        return 1.0
    lo, hi = 1e-6, 1.0
    value = lambda x: sum(p * math.exp(min(x * s, 700)) for s, p in parts)
    while value(hi) < 1 and hi < 100:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * w * (np.arange(len(w)) > 0)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from labelled documents that are not held out; the documents are read once, for the training rows."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    rows = ws.save(training_rows(docs, labels, "toxic", most).select("text", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("aside")), "training")
    kinds = {(r["aside"], r["label"]) for r in rows.select("aside", "label").distinct().collect()}  # at most four
    apart = len(kinds) == 4
    counted = rows.where("not aside") if apart else rows
    fitted = rows.where("aside") if apart else rows
    counts = counted.select("text", "label").mapInArrow(_counts, "token string, label int, docs long")
    one = lambda k: F.sum(F.when(F.col("label") == k, F.col("docs")).otherwise(0))
    both = counts.groupBy("token").agg(one(1).alias("y1"), one(0).alias("y0")).persist()
    totals = both.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0")).first()
    n1, n0 = totals["n1"] or 0, totals["n0"] or 0
    if not n1 or not n0:
        both.unpersist()
        return Model()
    # such a token is in many of the sample's toxic documents, so the list is bounded with the sample
    seen = both.where((F.col("y1") >= LEAST_DOCS) & (F.col("y1") * n0 > F.col("y0") * n1 * 3)).collect()
    both.unpersist()
    model, kept, rest = Model(), [], 1.0
    for r in seen:
        d, z = log_odds(r["y1"], r["y0"], n1, n0)
        if z >= LEAST_Z and d >= LEAST_ODDS:
            model.scores[r["token"]] = d
            kept.append((d - DRIFT, r["y0"] / n0))
            rest -= r["y0"] / n0
    model.rate = _solve_rate([*kept, (-DRIFT, rest)])
    evidence = lambda: fitted.select("text", "label").mapInArrow(_evidence(spark.sparkContext.broadcast(model)), "label int, best double, total double, top double, n long").toPandas()
    e = evidence()  # five numbers for each document of the sample
    clean = e[e.label == 0]
    exponent = np.clip(model.rate * clean.top, 0, 600)
    model.k = float(len(clean) / max((np.maximum(clean.n, 1) * np.exp(-exponent)).sum(), 1e-9))
    e = evidence()
    x = np.column_stack([np.ones(len(e)), e.best, e.total])
    model.weights = tuple(float(v) for v in logistic(x, e.label.to_numpy(float)))
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = WordScores(model.scores)
        for keys, some in texts_of(batches, "doc_id"):
            out = [score_of(model, t, table) for t in some]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scored(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_of(model: Model, text: bytes | None, table: WordScores) -> float:
    words = (text or b"").split()
    return probability(model, *features(model, np.fromiter(map(table.__getitem__, words), np.float64, len(words))))


def _probability(shared):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        table = WordScores(model.scores)
        for column in columns:
            yield pa.array([score_of(model, t, table) for _, _, some in runs_of(column) for t in some], pa.float64())

    return F.arrow_udf(run, "double")


def toxicity(docs: DataFrame, model: Model) -> Column:
    """The score of the column ``text``; only texts go to Python, and only numbers come back."""
    return _probability(docs.sparkSession.sparkContext.broadcast(model))(F.col("text").cast("string"))


def unflagged(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; nothing is shuffled."""
    return docs.where(toxicity(docs, model) < THRESHOLD)


def _passages(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = WordScores(model.scores)
        for keys, some in texts_of(batches, "doc_id"):
            rows = []
            for key, text in zip(keys, some, strict=True):
                words = (text or b"").split()
                s = np.fromiter(map(table.__getitem__, words), np.float64, len(words))
                offset = math.log(max(model.k * max(len(words), 1), 1e-9))
                for begin, end, value in segments(s):
                    e = math.exp(-max(-50.0, model.rate * value - offset))
                    if e < 1:
                        rows.append((key, begin, end, value, -math.expm1(-e), b" ".join(words[begin:end]).decode("utf-8", "replace")))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "begin", "end", "score", "p_value", "passage"])

    return run


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, begin, end, score, p_value, passage): every passage expected less than once by chance in its document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_passages(shared), "doc_id long, begin int, end int, score double, p_value double, passage string")

"""Licence scans by a trained paragraph classifier (operator 6), in DataFrame functions only.

A paragraph is a line, with the lines that wrap on from it: a line break is a wrap where
the line before it has no final mark, no more than 120 letters, and no room for the
next word, behind comment marks or not. It is described by its distinct word 1- and 2-grams. A multinomial logistic regression over them gives each licence family, and a
class for text that grants no licence, a probability; the weights are trained here, on
the driver, from paragraphs of public notices, mutilated copies and pieces of them and
everyday sentences that use the same words. A temperature fitted on copies kept from training
calibrates the probabilities; under ``SURE`` the family is unknown. A prediction is
confirmed when the paragraph holds ``LIKE`` of the word 3-grams of one of the family's
notices, and an unconfirmed one is unknown: words alone name no licence. Everyday sentences of
several languages train the unknown class, so that no foreign word decides.

``score`` describes every paragraph with a word and gives each a row. ``scan`` leaves
out those that stay unknown and have no word of ``ANCHORS``.
The weights are arrays bounded by the notices, fixed in the plan, and the notices a small
table that is broadcast.
Sentences that several licences share (disclaimers) name none: they are unknown.

Defined results: null and empty texts have no paragraphs; a text's equal paragraphs
are rows of their own, by place; repeated documents and null ids have their own rows; of
families that tie in probability the first wins; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import IDENTIFIERS, NOTICES, OTHERS

SURE = 0.6
LIKE = 0.6
UNKNOWN = "unknown"

#: Words that speak of licences.
ANCHORS = ("license", "licensed", "licence", "licenced", "permission", "redistribution", "gpl", "cc", "cc0", "domain", "mozilla", "spdx")
#: Letters of a line and of the next one's first word that don't fit into about 70 columns together.
FULL = ((66, 1), (64, 4), (62, 6), (60, 8), (57, 11), (54, 14), (50, 18))
#: A line break inside a paragraph (Java and ``regex`` syntax). Marks of comments may stand before the next line.
WRAP = r"\n(?<=[^\s.!?:;][ \t\r]{0,4}\n)(?<=(?:\A|\n)[^\n]{50,120}\n)(?:" + "|".join(rf"(?<=[^\n]{{{a}}}\n)(?=[ \t#/*;>|-]*[^\s#/*;>|-]\S{{{b - 1}}})" for a, b in FULL) + ")"


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    bias: list[float]
    weights: dict[str, list[float]]  # divided by the temperature, like the bias


def _mutilated(words: list[str], rng: np.random.Generator, fillers: list[str]) -> list[str]:
    """A copy without some words and with some strange ones."""
    kept = [w for w in words if rng.random() > 0.1] or words
    for _ in range(int(rng.integers(0, 5))):
        kept = [*kept, str(rng.choice(fillers))] if rng.random() < 0.5 else [str(rng.choice(fillers)), *kept]
    return kept


@functools.cache
def fit(copies: int = 12, steps: int = 250, ridge: float = 2e-4) -> Model:
    """Train on the notices. The data are the fixed values above, so the work does not depend on the corpus."""
    rng = np.random.Generator(np.random.PCG64(6))
    families = [*NOTICES, UNKNOWN]
    fillers = [w for s in OTHERS for w in words_of(s) if w not in ANCHORS]
    rows: list[tuple[set[str], int, bool]] = []
    for k, family in enumerate(families):
        for text in NOTICES.get(family, OTHERS):
            words = words_of(text)
            rows.append((grams(words), k, False))
            rows += [(grams(_mutilated(words, rng, fillers)), k, n % 4 == 3) for n in range(copies)]
            if len(words) > 20:  # pieces, as a scan meets them where a wrap isn't seen
                starts = [int(x) for x in rng.integers(0, len(words) - 12, copies // 2)]
                rows += [(grams(words[x : x + 12 + int(rng.integers(0, 12))]), k, n % 4 == 3) for n, x in enumerate(starts)]
    for anchor in ANCHORS:  # an anchor among everyday words grants nothing
        rows += [(grams([*map(str, rng.choice(fillers, 4)), anchor, *map(str, rng.choice(fillers, 4))]), len(families) - 1, n == 3) for n in range(4)]
    vocabulary = {g: n for n, g in enumerate(sorted(set().union(*(r[0] for r in rows if not r[2]))))}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for n, (own, _, _) in enumerate(rows):
        x[n, [vocabulary[g] for g in own if g in vocabulary]] = 1
    y = np.eye(len(families))[[r[1] for r in rows]]
    aside = np.array([r[2] for r in rows])
    w, m, v = np.zeros((x.shape[1], len(families))), 0.0, 0.0
    xt, yt = x[~aside], y[~aside]
    for t in range(1, steps + 1):
        z = xt @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = xt.T @ (p - yt) / len(yt) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def loss(divisor: float) -> float:
        z = x[aside] @ w / divisor
        z -= z.max(axis=1, keepdims=True)
        return float(-((z - np.log(np.exp(z).sum(axis=1, keepdims=True))) * y[aside]).sum())

    divisor = min((0.25 * 1.1**k for k in range(40)), key=loss)
    w = w / divisor
    return Model(families, w[-1].tolist(), {g: w[n].tolist() for g, n in vocabulary.items()})


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, doc_id, paragraph, words) of the paragraphs with a word; ``paragraph`` counts all of them from 0, blank lines too."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows are told apart by a number of their own: a table may repeat a document
    lines = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.posexplode(F.split(F.regexp_replace("text", WRAP, " "), "\n")).alias("paragraph", "line"))
    return lines.select("row", "doc_id", "paragraph", F.filter(F.split(F.lower("line"), "[^a-z0-9]+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)


def _runs(n: int) -> Column:
    """The n-grams of the column ``familiar``, where strange words are null: those without one. Every word is read a fixed number of times."""
    out = F.col("familiar")
    for k in range(1, n):
        out = F.zip_with(out, F.slice("familiar", k + 1, F.greatest(F.size("familiar") - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda x: x.isNotNull())  # the shorter side is filled with nulls


def templates(family: str) -> tuple[str, ...]:
    """The texts that confirm a family: its notices and its short names."""
    return (*NOTICES.get(family, ()), *IDENTIFIERS.get(family, ()))


def threes(words: list[str]) -> list[str]:
    return sorted({" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))})


def _numbers(values: list, kind: str) -> Column:
    """A fixed array as one literal; the optimizer makes it once."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


SLOTS = 1 << 15


def _places(grams: list[str]) -> list[int]:
    """A table in which each gram is in one of its two slots (cuckoo hashing); -1 is empty."""
    table = [-1] * SLOTS

    def slots(n: int) -> tuple[int, int]:
        g = grams[n].encode()
        signed = xxhash.xxh64_intdigest(g, 42)
        return (signed - (1 << 64) if signed >> 63 else signed) % SLOTS, zlib.crc32(g) % SLOTS

    for first in range(len(grams)):
        n, at = first, slots(first)[0]
        for _ in range(1000):
            n, table[at] = table[at], n
            if n < 0:
                break
            a, b = slots(n)
            at = b if at == a else a
        else:
            raise ValueError("the grams don't fit the table")
    return table


def _known(all: Column, grams: list[str]) -> Column:
    """The numbers of those grams of an array that are in a fixed list."""
    table, names = _numbers(_places(grams), "int"), F.split(F.lit("\n".join(grams)), "\n")

    def number(g: Column) -> Column:
        one, two = F.get(table, F.pmod(F.xxhash64(g), F.lit(SLOTS))), F.get(table, F.crc32(g) % SLOTS)
        return F.when(F.get(names, one) == g, one).when(F.get(names, two) == g, two)

    return F.filter(F.transform(all, number), lambda x: x.isNotNull())


def _summed(bias: float, weights: list[float]) -> Column:
    own = _numbers(weights, "double")
    return F.aggregate("found", F.lit(bias), lambda a, x: a + F.get(own, x))


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed, anchored, likely) of each paragraph.

    ``likely`` is what the classifier says, ``family`` what a template confirms. The weights
    are added up inside the row, so nothing is shuffled.
    """
    spark = docs.sparkSession
    model = model or fit()
    k = len(model.families)
    theirs = {f: [threes(words_of(t)) for t in templates(f)] for f in NOTICES}
    notices = spark.createDataFrame(list(theirs.items()), "family string, theirs array<array<string>>")
    known = sorted({x for own in theirs.values() for t in own for x in t})

    mine = F.when(F.size("words") < 3, F.array(F.array_join("words", " "))).otherwise(_runs(3))
    # no longer than the notices, however long the paragraph
    shared = F.array_distinct(F.filter(mine, lambda x: x.isin(known)))
    found = _known(F.array_distinct(F.concat(_runs(1), _runs(2))), sorted(model.weights))
    # known grams are made of these words, so longer ones are made of nothing else
    familiar = sorted({w for g in (*model.weights, *known) for w in g.split(" ")})
    read = paragraphs(docs).withColumn("familiar", F.transform("words", lambda w: F.when(w.isin(familiar), w)))
    described = read.select("doc_id", "paragraph", shared.alias("shared"), F.exists("words", lambda w: w.isin(*ANCHORS)).alias("anchored"), found.alias("found"))
    rows = [model.weights[g] for g in sorted(model.weights)]
    summed = [_summed(model.bias[c], [r[c] for r in rows]) for c in range(k)]
    scored = described.withColumn("z", F.array(*summed)).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("best", (F.array_position("z", F.col("top")) - 1).cast("int")).withColumn("p", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    named = scored.withColumn("likely", F.when(F.col("p") >= SURE, F.array(*map(F.lit, model.families))[F.col("best")]).otherwise(F.lit(UNKNOWN)))
    compared = named.join(F.broadcast(notices.withColumnRenamed("family", "likely")), "likely", "left")
    similarity = F.coalesce(F.array_max(F.transform("theirs", lambda t: F.size(F.array_intersect("shared", t)) / F.size(t))), F.lit(0.0))
    out = compared.withColumn("similarity", similarity).withColumn("confirmed", F.col("similarity") >= LIKE)
    return out.select("doc_id", "paragraph", F.when(F.col("confirmed"), F.col("likely")).otherwise(F.lit(UNKNOWN)).alias("family"), F.col("p").alias("probability"), "similarity", "confirmed", "anchored", "likely")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``score`` without the unknown paragraphs that have no anchor word."""
    return score(docs, model).where((F.col("family") != UNKNOWN) | F.col("anchored")).drop("anchored")

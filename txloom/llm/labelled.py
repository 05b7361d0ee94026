"""Labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a model is fitted on, the first in the order of a hash of their ids.
SAMPLE = 20_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text leaves 1 on division by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` documents that are labelled and not held out.

    Null labels are no labels; an id with both labels is left out. An id that the table repeats
    counts once, with the text of the least hash, so ``most`` bounds the rows as well.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    n = one.count()
    if n > 3 * most:  # a bound on the hash leaves a little over `most` rows to sort
        one = one.where(F.xxhash64("doc_id") < int(-(2**63) + 2**64 * min(0.99, 1.5 * most / n)))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    every = texts.join(F.broadcast(some), "doc_id")  # at most `most` rows of two numbers
    return every.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))

"""A corpus clean-up in five stages, each written and read again before the next.

Toxic documents go, then those of low quality, then all but one of each group of near
duplicates, then those that hold a benchmark item; the rest is packed into sequences.
Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Decisions are made for each row, so rows with a repeated or null ``doc_id`` are documents
of their own: none goes for what another row of its id holds. Null and empty texts are
scored, link with nothing and hold nothing; other columns are passed on. Stages on empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txloom.llm import decontam, minhash, packing, quality, toxicity
from txloom.llm.encode import default_tokenizer
from txloom.llm.queries import table
from txloom.llm.workspace import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.unflagged(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted of quality."""
    return quality.good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates."""
    return minhash.deduplicated(docs, Workspace(spark, "pipeline-minhash"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    pieces = packing.encode_pieces(docs, default_tokenizer(), Workspace(spark, "pipeline-packing"))
    return packing.place(pieces).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained stages can't be written in SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs

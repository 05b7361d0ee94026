"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, dialogue, divergence, html_extract, licenses, minhash, packing, privacy, quality, token_store, toxicity, vector_dedup
from .encode import default_tokenizer
from .workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), default_tokenizer(), ws)
    return token_store.verify(spark, ws)


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), Workspace(spark, "vector-dedup"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "packing")
    pieces = packing.encode_pieces(table(spark, sf_dir, "documents"), default_tokenizer(), ws)
    return packing.place(pieces).drop("ids")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.score(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    ws = Workspace(spark, "chat")
    return chat.digests(chat.format_windows(turns.unionByName(probe), default_tokenizer(), ws))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "minhash"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), Workspace(spark, "html"))


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return dialogue.summary(turns, dialogue.damaged(turns), Workspace(spark, "dialogue"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Workspace(spark, "divergence"))


def op13_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digests(privacy.scan(table(spark, sf_dir, "documents"), Workspace(spark, "privacy")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_vector_dedup": op2_vector_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_quality": op4_quality,
        "op5_packing": op5_packing,
        "op6_license_scan": op6_license_scan,
        "op7_chat_format": op7_chat_format,
        "op8_toxicity": op8_toxicity,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_html_text": op10_html_text,
        "op11_dialogue_repair": op11_dialogue_repair,
        "op12_source_divergence": op12_source_divergence,
        "op13_privacy": op13_privacy,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.SQL, "op11_dialogue_repair": dialogue.SQL, "op12_source_divergence": divergence.SQL}

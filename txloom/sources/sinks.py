"""Sinks: results by client, tables, and layouts on disk that later queries need not shuffle or read whole."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from txloom import schemas


def write_results(df: DataFrame, path: str, partition: str = "client_id") -> None:
    """CSV with a header, a folder for each client; an empty result still writes its header.

    Only the folders of clients with rows are replaced, so other clients' results stay as
    they are. The rows are counted as they are written; the query runs once.
    """
    if partition not in df.columns:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(partition).csv(path)
    if not seen.get["n"]:
        df.limit(0).write.mode("append").option("header", True).csv(path)


def write_client(df: DataFrame, path: str, client: str, partition: str = "client_id") -> None:
    """One client's result in its folder, in place of what is there; a client without rows gets a header."""
    own = df.where(F.col(partition) == client).drop(partition)
    own.write.mode("overwrite").option("header", True).csv(f"{path}/{partition}={quote(client, safe=' ')}")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_period(tx: DataFrame, path: str, letters: int = 10) -> None:
    """Transfers in a folder for each day (10 letters of ``ts_text``) or month (7), so that a period reads its own files only.

    Rows are dealt by the period and a hash of the row, in pieces of a task each, so a busy day is
    several files and a quiet one is few.
    """
    schemas.free(tx, "period")
    dated = tx.withColumn("period", F.translate(F.substring("ts_text", 1, letters), "/", "-"))
    dated.repartition("period", F.pmod(F.xxhash64("from_account", "to_account"), F.lit(4))).write.mode("overwrite").partitionBy("period").parquet(path)

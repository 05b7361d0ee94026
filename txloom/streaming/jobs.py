"""Structured Streaming jobs over finite or endless sources.

State lives in Spark's state store and the checkpoint, so a restart goes on where it
stopped. ``run_to_end`` takes what is there (``availableNow``) and gives the end state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom import schemas, scratch
from txloom.streaming import state

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, mode: str, name: str, checkpoint: str | None = None, table: str | None = None) -> DataFrame:
    """Run a stream over what its source holds and read back what it wrote.

    In complete mode each batch replaces the table; in append mode each batch has a
    folder of its own number, so that a batch that is run again writes over itself.
    """
    spark = stream.sparkSession
    table = table or scratch.folder(spark, name)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(table if mode == "complete" else f"{table}/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or scratch.folder(spark, f"{name}-checkpoint")).trigger(availableNow=True)
    query = with_rocksdb(spark, writer.start)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(table).select(*schema.names)


def with_rocksdb(spark: SparkSession, start: Callable):
    """Start a query with the state store that keyed state needs; a query keeps the settings it started with, so the session's are put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def count_by_client(events: DataFrame, checkpoint: str | None = None, table: str | None = None) -> DataFrame:
    """Running count of each client; with the checkpoint and table of an earlier run it goes on from there."""
    return run_to_end(events.groupBy("client_id").agg(F.count("*").alias("count")), "complete", "count", checkpoint, table)


def largest_by_client(events: DataFrame, checkpoint: str | None = None, table: str | None = None) -> DataFrame:
    """Running largest value of each client with its event, the least event id on ties."""
    best = F.max(F.struct("value", (-F.col("event_id")).alias("neg"))).alias("best")
    ended = run_to_end(events.where("value is not null").groupBy("client_id").agg(best), "complete", "largest", checkpoint, table)
    return ended.select("client_id", F.col("best.value").alias("value"), (-F.col("best.neg")).alias("event_id"))


def _without_repeats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeats inside a batch go before rows are shuffled, so a hot group brings its values, not its rows."""
    for frame in frames:
        yield frame.drop_duplicates()


def distinct_values(events: DataFrame, group: list[str], value: list[str], passes: int) -> DataFrame:
    """A streaming frame of (group, value, n_values): a group's distinct values as it passes ``passes`` of them, then each new one.

    A row's ``n_values`` is the group's number of values when it left. Nulls of groups and values are empty texts.
    """
    schemas.free(events.select(*group, *value), "n_values")
    texts = events.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in [*group, *value]))
    schema = ", ".join(f"`{c}` string" for c in [*group, *value])
    return texts.mapInPandas(_without_repeats, schema).groupBy(*group).transformWithStateInPandas(state.DistinctValues(group, value, passes), schema + ", n_values long", "append", "none")


def distinct_by_group(events: DataFrame, group: list[str], value: list[str], expected: int, comparison: str = "gt", explode: bool = False, checkpoint: str | None = None, table: str | None = None) -> DataFrame:
    """Groups that pass a number of distinct values, with their number; with ``explode`` their values.

    Rows are written while the stream runs, when a group passes; what is read here is what they add up to.
    """
    if comparison not in ("gt", "gte"):
        raise ValueError("a running set can pass a threshold, but not stay at one: gt or gte")
    sent = run_to_end(distinct_values(events, group, value, expected + (comparison == "gt")), "append", "distinct", checkpoint, table)
    return sent.select(*group, *value) if explode else sent.groupBy(*group).agg(F.max("n_values").alias("n_values"))


def first_rows(events: DataFrame, key: list[str], remember: str = "30 days") -> DataFrame:
    """A streaming frame without replays of a key, as long as it is remembered; rows with a null key part are never replays and all stay.

    A key is remembered from its arrival on, not by the rows' own time, so old rows that
    come late are rows like others; it leaves the state when its time is over and other
    rows have come.
    """
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    first = _arriving(events.where(~missing)).groupBy(*key).transformWithStateInPandas(state.FirstOfKey(events.columns, _ms(remember)), events.schema, "append", "eventTime")
    return first.unionByName(events.where(missing))


def once(events: DataFrame, key: list[str], remember: str = "30 days", checkpoint: str | None = None, table: str | None = None) -> DataFrame:
    """The rows of ``first_rows``. The keys are in the checkpoint, so replays after a restart are dropped as well."""
    return run_to_end(first_rows(events, key, remember), "append", "once", checkpoint, table)


def _arriving(rows: DataFrame) -> DataFrame:
    """Rows with the time of their batch as the stream's time: none is ever late, and timers go by arrival.

    Timers by processing time would keep a run over what is there from ending.
    """
    schemas.free(rows, "arrived", "arrived_ms")
    return rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 second").withColumn("arrived_ms", F.unix_millis("arrived"))


def _ms(duration: str) -> int:
    number, unit = duration.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000


def _part_counts(owner: str):
    def combined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby(["client_id", owner], dropna=False, as_index=False).agg(n=("n", "sum"), discard=("discard", "max"))

    return combined


def live_counts(events: DataFrame, owner: str, discard: Column, remember: str = "1 day") -> DataFrame:
    """A streaming frame of (client_id, change): how each client's count changes as rows come and parts (``owner``) are discarded."""
    marked = events.select("client_id", owner, F.lit(1).cast("long").alias("n"), F.coalesce(discard, F.lit(False)).alias("discard"))
    owned = marked.where(F.col(owner).isNotNull()).mapInPandas(_part_counts(owner), marked.schema)
    live = _arriving(owned).groupBy("client_id", owner).transformWithStateInPandas(state.LiveParts("client_id", _ms(remember)), "client_id string, change long", "append", "eventTime")
    # rows without an owner can't be discarded
    return live.unionByName(marked.where(F.col(owner).isNull()).select("client_id", F.col("n").alias("change")))


def count_after_discard(events: DataFrame, owner: str, discard: Column, checkpoint: str | None = None, table: str | None = None) -> DataFrame:
    """Count of each client without the parts that a row discards, whether it comes before or after them.

    A discarded part's count leaves the state; see ``live_counts``. Clients without a live row have none.
    """
    changes = run_to_end(live_counts(events, owner, discard), "append", "discard", checkpoint, table)
    return changes.groupBy("client_id").agg(F.sum("change").alias("count")).where("count <> 0")


def two_inputs(first: DataFrame, second: DataFrame, finish: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Both streams land in tables of their own, rows of either wait there; ``finish`` runs when both have ended."""
    return finish(run_to_end(first, "append", "first"), run_to_end(second, "append", "second"))


SHARDS = 16


def _tagged(key: str, names: list[str], shards: int):
    """Early rows become a sum for each key, sent to all shards; late rows go to one shard each."""

    def tagged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            early = frame[frame["early"]]
            sums = early.groupby(key, as_index=False).agg(ts=("ts", "max"), amount=("amount", "sum"), n=("early", "size"))
            copies = sums.merge(pd.DataFrame({"shard": range(shards)}), how="cross")
            late = frame[~frame["early"]].assign(n=0)
            late["shard"] = pd.util.hash_pandas_object(late[[*names, "amount"]], index=False).to_numpy() % shards
            out = pd.concat([copies.reindex(columns=[key, "shard", "ts", *names, "amount", "n"]), late[[key, "shard", "ts", *names, "amount", "n"]]])
            yield out.astype({"shard": "int64", "amount": "int64", "n": "int64"})

    return tagged


def below_baseline(rows: DataFrame, early: Column, late: Column, early_end: str, names: list[str], key: str = "payment_format", amount: str = "amount_paid", ratio: float = 0.01, delay: str = "1 hour", scale: int = 4, shards: int = SHARDS) -> DataFrame:
    """A streaming frame of late rows (key, names, amount) under ``ratio`` of the early mean of their key.

    One stream brings both: late rows wait in keyed state until the watermark has passed
    ``early_end``, as no early row can come then; later ones are answered at once. A key's late
    rows are dealt to ``shards`` tasks, to which its early rows come as sums, so a hot
    key is not one task. Needs ``ts``; rows later than ``delay`` are dropped. Amounts are whole units of 10^-scale.
    """
    units = 10**scale
    end_ms = int(pd.Timestamp(early_end, tz="UTC").timestamp() * 1000)
    texts = [F.col(c).cast("string").alias(c) for c in names]
    # text keys; a null key has no baseline
    marked = rows.where((early | late) & F.col(key).isNotNull() & F.col(amount).isNotNull()).select(F.col(key).cast("string").alias(key), "ts", *texts, (F.col(amount) * units).cast("long").alias("amount"), early.alias("early"))
    columns = ", ".join(f"`{c}` string" for c in names)
    dealt = marked.mapInPandas(_tagged(key, names, shards), f"`{key}` string, shard long, ts timestamp, {columns}, amount long, n long").withWatermark("ts", delay)
    found = dealt.groupBy(key, "shard").transformWithStateInPandas(state.Baseline([*names, key], ratio, end_ms, units), f"{columns}, `{key}` string, amount long", "append", "eventTime")
    return found.select(*names, key, (F.col("amount") / units).alias(amount))


def windowed_counts(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts by tumbling window; in append mode windows past the last watermark stay open, so this is complete."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_to_end(counts.select(F.col("w.start").alias("start"), "event_type", "n"), "complete", "windows")


#: Keys of the state of silent entities; a checkpoint holds for one number of them.
BUCKETS = 4096


def silent_alerts(events: DataFrame, entity: str, timeout_s: int, delay: str = "1 hour", roster: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A streaming frame of (entity, from_s, reported, alert): the entity was silent for ``alert`` timeouts since the second ``from_s``.

    Time is event time: an alert leaves when the watermark has passed it, and restarts don't
    change what leaves. The clock restarts with each event and each alert. ``roster`` (entity, since)
    names entities that are watched from ``since`` on though they never report; their alerts have ``reported`` false. Needs ``ts``.
    """
    schemas.free(events.select(entity), "bucket")
    kind = events.schema[entity].dataType.simpleString()
    # entities as texts: pandas has no whole numbers with nulls
    text = F.col(entity).cast("string").alias(entity)
    bucket = F.pmod(F.xxhash64(F.col(entity).cast("string")), F.lit(buckets)).alias("bucket")
    known = roster.select(bucket, text, F.unix_timestamp("since").alias("since")).groupBy("bucket") if roster is not None else None
    timed = events.withWatermark("ts", delay).select(bucket, text, "ts", F.unix_timestamp("ts").alias("at"))
    found = timed.groupBy("bucket").transformWithStateInPandas(state.Silence(entity, timeout_s), f"`{entity}` string, from_s long, reported boolean, alert long", "append", "eventTime", known)
    return found.withColumn(entity, F.col(entity).cast(kind))

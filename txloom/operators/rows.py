"""Projection, splitting, samples and layout: operators that look at rows one by one or at their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txloom import schemas, scratch
from txloom.functions import scalars

#: Payment formats in the order in which planted rows take them (fixed values).
PAYMENT_FORMATS = ("Wire", "ACH", "Cheque", "Credit Card", "Cash", "Reinvestment")


def project(df: DataFrame, fields: list[str], int_fields: tuple[str, ...] = (), tenant: str | None = "client_id", rename: dict[str, str] | None = None) -> DataFrame:
    """The listed columns in order, absent ones left out; the tenant column always stays.

    ``int_fields`` become whole numbers' text where they are whole numbers.
    """
    wanted = [f for f in fields if f in df.columns]
    if tenant and tenant in df.columns and tenant not in wanted:
        wanted.append(tenant)
    out = df.select(*(scalars.int_or_text(F.col(f).cast("string")).alias(f) if f in int_fields else F.col(f) for f in wanted))
    return out.withColumnsRenamed(rename or {})


def split_cases(df: DataFrame, field: str, cases: list[tuple[str, str, str]], name: str = "case") -> DataFrame:
    """Label rows, in the new column ``name``, with the first case (label, low, high) whose range holds the first ten characters; others go."""
    schemas.free(df, name)
    value = F.substring(F.col(field), 1, 10)
    label = reduce(lambda c, x: c.when(value.between(x[1], x[2]), x[0]), cases[1:], F.when(value.between(cases[0][1], cases[0][2]), cases[0][0]))
    return df.withColumn(name, label).where(F.col(name).isNotNull())


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """(row, rank): every row as a struct, with its place from 1 in a global order.

    The order is made once and written: range partitions, each sorted, with the row's place
    in its partition. Places and partition sizes are both read from that table, so they can't
    come from two different cuts, whatever columns a later step prunes. Ties of ``order`` are
    broken by a hash of the row, which also spreads a hot key over partitions; only rows that
    are equal throughout share a partition. Nulls come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    hashed = F.xxhash64(F.to_json("row"))  # also of maps, which have no hash of their own
    keyed = rows.select("row", *(F.col("row").getField(c).alias(f"k{i}") for i, c in enumerate(order)), hashed.alias("tie"))
    keys = [*(f"k{i}" for i in range(len(order))), "tie"]
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    placed = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("row", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place"))
    placed = scratch.saved(placed, "ranked")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition, whatever the table's size
    return placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("row", (F.col("before") + F.col("place") + 1).alias("rank"))


def with_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """All columns and ``name``, the row's place from 1 in a global order; see ``ranked``."""
    schemas.free(df, name)
    return ranked(df, *order).select("row.*", F.col("rank").alias(name))


def systematic_sample(df: DataFrame, percent: float, *order: str) -> DataFrame:
    """Row i of the order stays where i * percent / 100 passes a whole number; all columns of the row stay."""
    return ranked(df, *order).where(F.floor(F.col("rank") * percent / 100) > F.floor((F.col("rank") - 1) * percent / 100)).select("row.*")


def hash_sample(df: DataFrame, percent: float, *key: str) -> DataFrame:
    """Independent draws that a key's hash decides, so that reruns agree."""
    return df.where(scalars.md5_bucket(F.concat_ws("|", *(F.col(k).cast("string") for k in key)), 10_000) <= int(percent * 100))


def bernoulli_sample(df: DataFrame, percent: float, seed: int) -> DataFrame:
    return df.sample(fraction=percent / 100, seed=seed)


def head_sample(df: DataFrame, percent: float, *order: str) -> DataFrame:
    """The first int(n * percent / 100) rows of an order, by ranks over range partitions: a tenth of a large table is large."""
    placed = ranked(df, *order)
    n = placed.agg(F.count("*")).first()[0]  # of the rows that were ranked, not of a second run of their plan
    return placed.where(F.col("rank") <= int(n * percent / 100)).select("row.*")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def partitioned(df: DataFrame, buckets: int, *keys: str, tenant: str | None = None) -> DataFrame:
    """Rows dealt to ``buckets`` by the MD5 bucket of their normalised key, which stays visible as ``bucket``."""
    key = scalars.composite_key(*(F.col(k) for k in keys), tenant=F.col(tenant) if tenant else None)
    return df.withColumn("bucket", scalars.md5_bucket(key, buckets)).repartition(buckets, "bucket")


def plant_scatter_gather(df: DataFrame, source: tuple[str, str], target: tuple[str, str], fanout: int, ts_text: str, amount: float, currency: str) -> DataFrame:
    """Append source -> B_i and B_i -> target for i below ``fanout`` (2..64).

    Minutes and amounts count up over the first legs and go on over the second; both legs
    of B_i have the same payment format, and formats take turns.
    """
    if not 2 <= fanout <= 64:
        raise ValueError("fanout must be from 2 to 64")
    schemas.require(df, "ts_text", "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "payment_currency", "payment_format")
    spark = df.sparkSession
    start = F.to_timestamp(F.lit(ts_text), "yyyy/MM/dd HH:mm")
    hops = spark.range(fanout).crossJoin(spark.range(2).withColumnRenamed("id", "leg"))  # at most 128 rows
    middle_bank, middle = F.lpad((900 + F.col("id") % 50).cast("string"), 3, "0"), F.concat(F.lit("MID"), F.lpad(F.col("id").cast("string"), 3, "0"))
    first = F.col("leg") == 0
    step = F.col("id") + F.col("leg") * fanout
    rows = hops.select(
        F.date_format(start + F.make_interval(mins=step.cast("int")), "yyyy/MM/dd HH:mm").alias("ts_text"),
        F.when(first, F.lit(source[0])).otherwise(middle_bank).alias("from_bank"),
        F.when(first, F.lit(source[1])).otherwise(middle).alias("from_account"),
        F.when(first, middle_bank).otherwise(F.lit(target[0])).alias("to_bank"),
        F.when(first, middle).otherwise(F.lit(target[1])).alias("to_account"),
        (F.lit(amount) + step).cast(df.schema["amount_paid"].dataType).alias("amount_paid"),
        F.lit(currency).alias("payment_currency"),
        F.array(*map(F.lit, PAYMENT_FORMATS))[(F.col("id") % len(PAYMENT_FORMATS)).cast("int")].alias("payment_format"),
    )
    return df.unionByName(rows, allowMissingColumns=True)

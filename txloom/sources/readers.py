"""Sources: CSV and Parquet scans with given schemas, batch envelopes, rates, and the views of a star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom import schemas
from txloom.operators import predicates

#: Payment formats by the first digit of an order's priority, and currencies by return flag.
FORMATS = {"1": "Wire", "2": "ACH", "3": "Cheque", "4": "Credit Card", "5": "Cash"}
CURRENCIES = {"N": "US Dollar", "A": "Euro", "R": "Yen"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A header line, no quoting; short rows are padded with nulls, long ones cut."""
    return spark.read.schema(schema).option("header", True).option("quote", "").option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The transaction file; columns are taken by place, so its two ``Account`` headers do no harm."""
    return _csv(spark, path, schemas.TRANSACTIONS)


def read_period(spark: SparkSession, path: str, limits: str) -> DataFrame:
    """Transfers of ``low,high`` (as the rule ``between``) from a table by period: other periods' folders are not read.

    Cutting texts keeps their order, so the limits cut to a period's letters bound the folders.
    """
    rows = spark.read.parquet(path)
    low, high = (x.strip().replace("/", "-") for x in limits.split(","))
    period, n = F.col("period").cast("string"), min(len(low), len(high))
    folders = rows.where((period >= F.substring(F.lit(low), F.lit(1), F.length(period))) & (F.substring(period, 1, n) <= high[:n])) if n else rows
    return predicates.keep(folders, ("between", "ts_text", limits)).drop("period")


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.ACCOUNTS)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.RATES)


def read_with_header(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose header may repeat names: the first line is read alone, repeats get ``.1``; all columns are text, split on every comma."""
    first = spark.read.text(path).limit(1).first()
    names = schemas.unique_headers(first[0].split(",")) if first else []
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).option("quote", "").option("enforceSchema", True).csv(path)


def envelope_rows(envelopes: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) of batches to (client_id, request_id, record map); each batch brings its column names."""
    e = envelopes.select(F.from_json("value", schemas.ENVELOPE).alias("e")).select("e.*")
    batch = e.select("client_id", "request_id", F.explode("batches").alias("b"))
    row = batch.select("client_id", "request_id", F.col("b.header.schema").alias("names"), F.explode("b.payload").alias("row"))
    # a row shorter than its names is padded, a longer one cut
    padded = F.transform("names", lambda n, i: F.get("row", i))
    return row.select("client_id", "request_id", F.map_from_arrays("names", padded).alias("record"))


def envelope_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of envelope files as a stream: files that have been read are in the checkpoint, so a restart reads new ones only."""
    return spark.readStream.text(path)


def bad_envelopes(envelopes: DataFrame) -> DataFrame:
    """The lines that ``envelope_rows`` can't take, with the reason: no JSON, no batches, or a batch without its column names.

    Blank lines are none; batches beside a bad one in the same line still give their rows.
    """
    e = F.from_json("value", schemas.ENVELOPE)
    reason = F.when(e.isNull() | F.coalesce(e["client_id"], e["request_id"], e["batches"].cast("string")).isNull(), "no envelope").when(e["batches"].isNull(), "no batches")
    reason = reason.when(F.exists(e["batches"], lambda b: b["header"]["schema"].isNull() & (F.size(b["payload"]) > 0)), "no column names")
    return envelopes.where(F.trim("value") != "").select("value", reason.alias("reason")).where("reason is not null")


def _choice(column, table: dict[str, str]):
    out = None
    for key, value in table.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


#: Bytes of a shuffle partition. Both sides of the join are sorted in one task, and a row takes about ten times the room there.
PIECE = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"


#: Bytes of files for each shuffle partition before any are merged, at most: the number of partitions grows with the tables.
FILES = 8 << 20
FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of files up to which Spark may send a table to all tasks. It goes by the files' size, and rows take twenty times that room and more in a task.
SENT = 1 << 20


def _file_bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def small_pieces(spark: SparkSession, *tables: DataFrame) -> None:
    """Partitions are merged up to 16 MB instead of Spark's 64, where the session has not set another size.

    Merging makes no partition smaller, so there are enough of them to begin with, whatever
    ``spark.sql.shuffle.partitions`` says: one for each 8 MB of the tables' files. A larger number of the session stays.
    """
    if PIECE[0] not in spark.conf.getAll:
        spark.conf.set(*PIECE)
    first = -(-sum(map(_file_bytes, tables)) // FILES)
    if first > int(spark.conf.get(FIRST, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(FIRST, str(first))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers out of order lines: customers send to parts, amounts are price times discount."""
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    small_pieces(spark, lines, orders)
    if _file_bytes(orders) > SENT:
        orders = orders.hint("merge")
    lines = lines.select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag")
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    bank = lambda c: F.lpad((F.col(c) % 25).cast("string"), 3, "0")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.date_format("o_orderdate", "yyyy/MM/dd HH:mm").alias("ts_text"),
        bank("o_custkey").alias("from_bank"),
        F.col("o_custkey").cast("string").alias("from_account"),
        bank("l_partkey").alias("to_bank"),
        F.col("l_partkey").cast("string").alias("to_account"),
        (F.col("l_extendedprice").cast("decimal(15,2)") * F.col("l_discount").cast("decimal(4,2)")).alias("amount_paid"),
        _choice(F.col("l_returnflag"), CURRENCIES).alias("payment_currency"),
        _choice(F.substring("o_orderpriority", 1, 1), FORMATS).alias("payment_format"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    key = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    return nation.select(F.col("n_name").alias("bank_name"), key.alias("bank_id"), F.concat(F.lit("A"), key).alias("account_number"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rates on the order days that are no multiple of seven; the yen is missing on some."""
    days = read_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("rate_date")).where("dayofmonth(o_orderdate) % 7 <> 0").distinct()
    number = F.dayofyear("rate_date")
    per_day = F.array(
        F.struct(F.lit("USD").alias("iso"), F.lit(1.0).alias("rate")),
        F.struct(F.lit("EUR").alias("iso"), (1 + (number % 50) / 1000).alias("rate")),
        F.struct(F.lit("JPY").alias("iso"), F.when(number % 5 > 0, (100 + number % 30).cast("double")).alias("rate")),
    )
    return days.select("rate_date", F.explode(per_day).alias("r")).select("rate_date", "r.iso", "r.rate").where("rate is not null")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as client requests; some ids are missing and some come twice."""
    return _requests(read_table(spark, sf_dir, "events"))


def _requests(e: DataFrame) -> DataFrame:
    client = F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string"))
    request = F.when(F.col("event_id") % 11 > 0, F.concat_ws(":", client, (F.col("user_id") % 17).cast("string"), F.lit("q1"), (F.col("event_id") % 700).cast("string")))
    return e.select("event_id", client.alias("client_id"), request.alias("request_id"), "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "user_id")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with the columns of ``requests``."""
    schema = read_table(spark, sf_dir, "events").schema
    # a pattern, since a stream takes one file only through a pattern
    return _requests(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))

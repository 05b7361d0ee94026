"""Column names and types of the relations, and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The raw transaction file has two columns named Account, so its schema is always given, never inferred.
TRANSACTIONS = T.StructType(
    [
        T.StructField("ts_text", T.StringType()),
        T.StructField("from_bank", T.StringType()),
        T.StructField("from_account", T.StringType()),
        T.StructField("to_bank", T.StringType()),
        T.StructField("to_account", T.StringType()),
        T.StructField("amount_received", T.StringType()),
        T.StructField("receiving_currency", T.StringType()),
        T.StructField("amount_paid", T.StringType()),
        T.StructField("payment_currency", T.StringType()),
        T.StructField("payment_format", T.StringType()),
        T.StructField("is_laundering", T.IntegerType()),
    ]
)
ACCOUNTS = T.StructType([T.StructField("bank_name", T.StringType()), T.StructField("bank_id", T.StringType()), T.StructField("account_number", T.StringType())])
RATES = T.StructType([T.StructField("rate_date", T.DateType()), T.StructField("iso", T.StringType()), T.StructField("rate", T.DoubleType())])
BATCHES = "array<struct<header: struct<schema: array<string>, client_id: string, count: int>, payload: array<array<string>>>>"
ENVELOPE = f"struct<client_id: string, request_id: string, batches: {BATCHES}>"

#: Raw headers by column, for files whose header has both accounts under one name.
RAW_HEADERS = {
    "Timestamp": "ts_text",
    "From Bank": "from_bank",
    "Account": "from_account",
    "To Bank": "to_bank",
    "Account.1": "to_account",
    "Amount Received": "amount_received",
    "Receiving Currency": "receiving_currency",
    "Amount Paid": "amount_paid",
    "Payment Currency": "payment_currency",
    "Payment Format": "payment_format",
    "Is Laundering": "is_laundering",
}


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself, if it has all the columns; else an error that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def free(df: DataFrame, *columns: str) -> None:
    """An error if the frame already has a column that an operator is about to add."""
    taken = [c for c in columns if c in df.columns]
    if taken:
        raise ValueError(f"the table already has columns {', '.join(taken)}; choose another name or rename them")


def unique_headers(names: list[str]) -> list[str]:
    """A second column of a name gets ``.1``, a third ``.2`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        out.append(f"{name}.{n}" if n else name)
        seen[name] = n + 1
    return out


def with_optional(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the schema's missing columns as typed nulls, in its order."""
    return df.select(*(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))

"""The five questions about payments, as functions of their tables.

The defaults follow the single-machine answers; parameters give the pipeline's rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions import scalars
from txloom.operators import aggregates, joins, predicates, rows

USD = ("eq", "payment_currency", "US Dollar")


def dollars(tx: DataFrame) -> DataFrame:
    """The filter that four questions share."""
    return predicates.keep(tx, USD)


def small_transfers(tx: DataFrame, limit: str = "50") -> DataFrame:
    """Dollar transfers under a limit."""
    kept = predicates.keep(dollars(tx), ("lt", "amount_paid", limit))
    return rows.project(kept, ["from_bank", "from_account", "to_bank", "to_account", "amount_paid"])


def largest_by_bank(tx: DataFrame, accounts: DataFrame, require_positive: bool = False) -> DataFrame:
    """Each sending bank's largest dollar transfer, its account and the bank's name; ties by time and accounts.

    The aggregate comes before the join: a row for each bank meets the names.
    """
    best = aggregates.largest(dollars(tx).select("from_bank", "amount_paid", "ts_text", "from_account", "to_account"), "from_bank", "amount_paid", "ts_text", "from_account", "to_account", positive=require_positive)
    return joins.with_bank_name(best, accounts).select("from_bank", "from_account", "bank_name", "amount_paid")


def below_baseline(tx: DataFrame, early: str, late: str, ratio: float = 0.01, in_cents: bool = False) -> DataFrame:
    """Dollar transfers of the late period under ``ratio`` of their payment format's mean in the early one."""
    usd = dollars(tx)
    found = joins.below_baseline(predicates.keep(usd, ("between", "ts_text", late)), predicates.keep(usd, ("between", "ts_text", early)), ratio=ratio, in_cents=in_cents)
    return found.select("from_bank", "from_account", "payment_format", "amount_paid")


def scatter_gather(tx: DataFrame, period: str, scatter_over: int = 5, gather_over: int = 5, drop_self_loops: bool = False, usd: bool = True, normalise=None, written: bool = False) -> DataFrame:
    """Pairs (A, C) joined over more than ``gather_over`` accounts, and their number; ``written`` as in ``scatter_gather_pairs``."""
    kept = predicates.keep(dollars(tx) if usd else tx, ("between", "ts_text", period))
    return joins.scatter_gather_pairs(kept, scatter_over, gather_over, drop_self_loops, normalise, written)


def scatter_gather_accounts(pairs: DataFrame) -> DataFrame:
    """The accounts of both ends, in order."""
    return joins.ends(pairs).orderBy("bank", "account")


def converted(tx: DataFrame, rates: DataFrame, usd_needs_rate: bool = True) -> DataFrame:
    """Add ``usd``: the amount at its day's rate; rows of unknown currency or without a rate go."""
    dated = tx.withColumn("rate_date", scalars.day(F.col("ts_text"))).withColumn("iso", scalars.iso_code(F.col("payment_currency"))).where("iso is not null")
    priced = joins.with_rate(dated, rates, usd_needs_rate)
    return priced.withColumn("usd", scalars.in_usd(F.col("amount_paid").cast("double"), F.col("iso"), F.col("rate")))


def tiny_transfers(tx: DataFrame, rates: DataFrame, period: str, formats: str = "Wire, ACH", limit: float = 1.0, usd_needs_rate: bool = True) -> DataFrame:
    """The number of transfers of the formats in the period worth less than ``limit`` dollars."""
    kept = predicates.keep(tx, ("between", "ts_text", period), ("in", "payment_format", formats))
    return aggregates.total_count(converted(kept, rates, usd_needs_rate).where(F.col("usd") < limit))

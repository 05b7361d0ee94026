"""Aggregations. Each groups on its key alone; counts and sums combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions import scalars

COMPARE = {"eq": lambda c, n: c == n, "gt": lambda c, n: c > n, "gte": lambda c, n: c >= n}


def total_count(df: DataFrame, tenant: str | None = None) -> DataFrame:
    """One row with ``count``, 0 for no rows; with a tenant column, a row for each tenant."""
    n = F.count("*").alias("count")
    return df.groupBy(tenant).agg(n) if tenant else df.agg(n)


def largest(df: DataFrame, key: str, amount: str, *ties: str, positive: bool = False) -> DataFrame:
    """The whole row with the largest amount of each key; ties go to the least of ``ties`` in order.

    ``positive`` drops keys whose largest amount is not over 0. The arg-max is one
    aggregate, so a hot key combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, amount, *ties)]
    # max on (amount, reversed ties) is not expressible on text, so min on (-amount, ties)
    best = F.min(F.struct((-F.col(amount)).alias("neg"), *(F.col(t) for t in ties), *(F.col(c) for c in rest))).alias("best")
    out = df.where(F.col(amount).isNotNull()).groupBy(key).agg(best).select(key, (-F.col("best.neg")).alias(amount), *(F.col(f"best.{c}") for c in (*ties, *rest)))
    return out.where(F.col(amount) > 0) if positive else out


def mean_by(df: DataFrame, key: str, amount: str, in_cents: bool = False) -> DataFrame:
    """Mean of each key; ``in_cents`` rounds every amount to whole cents, halves to even, first."""
    if in_cents:
        return df.groupBy(key).agg((F.sum(scalars.cents(F.col(amount))) / F.count(amount) / 100).alias("mean"))
    # the sum of decimals is exact, so the mean does not depend on the order of rows
    return df.groupBy(key).agg((F.sum(amount).cast("double") / F.count(amount)).alias("mean"))


def sum_and_count(df: DataFrame, key: str, amount: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null keys and values are the empty text, so that they count."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def distinct_values(df: DataFrame, group: list[str], values: list[str], expected: int, comparison: str = "gt", explode: bool = False) -> DataFrame:
    """Groups whose number of distinct values compares with ``expected``.

    Gives the group's keys and ``n_values``; with ``explode``, a row for each distinct
    value of the groups that pass. Rows are made distinct before they are counted.
    """
    rows = _filled(df, [*group, *values]).distinct()
    counts = rows.groupBy(*group).agg(F.count("*").alias("n_values"))
    passing = counts.where(COMPARE[comparison](F.col("n_values"), expected))
    return rows.join(passing.select(*group), group, "left_semi") if explode else passing


def most_connected(df: DataFrame, group: list[str], values: list[str], n: int = 5) -> DataFrame:
    """The n groups with the most distinct values, ties by key."""
    return distinct_values(df, group, values, 0).orderBy(F.desc("n_values"), *group).limit(n)


def having(df: DataFrame, group: list[str], over: int) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > over)


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def accounts_at_several_banks(df: DataFrame) -> DataFrame:
    """Accounts that occur, as sender or receiver, at more than one bank."""
    both = df.select(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")).unionByName(df.select(F.col("to_bank").alias("bank"), F.col("to_account").alias("account")))
    return both.distinct().groupBy("account").agg(F.count("*").alias("n_banks")).where("n_banks > 1")


def envelope_count(batches: DataFrame) -> DataFrame:
    """Announced counts where a batch has one, else the number of its payload rows."""
    rows = batches.select(F.explode("batches").alias("b"))
    return rows.agg(F.coalesce(F.sum(F.coalesce(F.col("b.header.count"), F.size("b.payload"))), F.lit(0)).alias("count"))


def reconciled(sent: DataFrame, got: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key on both sides; ``matches`` tells whether they agree."""
    left, right = (df.groupBy(*keys).agg(F.count("*").alias(name)) for df, name in ((sent, "n_sent"), (got, "n_got")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return left.join(right, list(keys), "full_outer").select(*keys, zero("n_sent"), zero("n_got"), (F.coalesce("n_sent", F.lit(0)) == F.coalesce("n_got", F.lit(0))).alias("matches"))


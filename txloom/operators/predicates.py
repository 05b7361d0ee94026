"""Predicates from configuration: (operator, field, value) to a Column.

A predicate on a column that the frame lacks is false; a null value fails. A rule compares
the bare column with a literal of its own type wherever that says the same, so that scans
can take it: text ranges instead of cut texts, whole numbers and decimals instead of casts.
"""

from __future__ import annotations

import decimal
import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _column(field: str) -> Column:
    return F.col(f"`{field}`")


def _never() -> Column:
    return F.lit(False)


def _whole(kind: T.DataType, text: str) -> int | None:
    """The number whose text is ``text`` if the type has it."""
    try:
        n = int(text)
    except ValueError:
        return None
    half = 1 << (_BITS[type(kind)] - 1)
    return n if str(n) == text and -half <= n < half else None


def equal(column: Column, kind: T.DataType, value: str) -> Column:
    """The same text."""
    if type(kind) in _BITS:
        n = _whole(kind, value)
        return _never() if n is None else column == F.lit(n).cast(kind)
    return (column if isinstance(kind, T.StringType) else column.cast("string")) == F.lit(value)


def less(column: Column, kind: T.DataType, value: str) -> Column:
    """Strictly less: as numbers if ``value`` is one, then what is no number fails; else as text."""
    try:
        bound = float(value)
    except ValueError:
        return (column if isinstance(kind, T.StringType) else column.cast("string")) < F.lit(value)
    if math.isnan(bound):
        return _never()
    if type(kind) in _BITS and math.isfinite(bound):
        top = math.ceil(decimal.Decimal(value.strip().replace("_", "")))
        half = 1 << (_BITS[type(kind)] - 1)
        return column.isNotNull() if top >= half else _never() if top <= -half else column < F.lit(top).cast(kind)
    if isinstance(kind, T.DecimalType) and math.isfinite(bound):
        with decimal.localcontext(prec=400):
            top = decimal.Decimal(value.strip().replace("_", "")).quantize(decimal.Decimal(1).scaleb(-kind.scale), decimal.ROUND_CEILING)
            most = decimal.Decimal(10) ** (kind.precision - kind.scale)
            return column.isNotNull() if top >= most else _never() if top <= -most else column < F.lit(top).cast(kind)
    return (column if isinstance(kind, T.DoubleType) else column.try_cast("double")) < F.lit(bound)


def _after(prefix: str) -> str | None:
    """The least text above all that begin with ``prefix``; None if there is none."""
    while prefix and ord(prefix[-1]) == sys.maxunicode:
        prefix = prefix[:-1]
    if not prefix:
        return None
    last = ord(prefix[-1]) + 1
    return prefix[:-1] + chr(0xE000 if last == 0xD800 else last)


def between(column: Column, kind: T.DataType, value: str) -> Column:
    """``low,high``: text order, ends included, on the value cut to the shorter limit's length.

    Cutting the value is the same as a range of whole values: the cut value is at least a low
    limit of that length where the value is, above a longer one where it is past all values
    with that beginning, and at most a high limit where it is before what follows them.
    """
    limits = [x.strip() for x in value.split(",")]
    if len(limits) != 2:
        raise ValueError(f"two limits are needed: {value!r}")
    low, high = limits
    n = min(len(low), len(high))
    text = column if isinstance(kind, T.StringType) else column.cast("string")
    start, end = low if len(low) == n else _after(low[:n]), _after(high[:n])
    if start is None:  # a longer low limit, and no value lies past its beginning
        return _never()
    kept = text >= F.lit(start)
    return kept & (text < F.lit(end)) if end is not None else kept


def within(column: Column, kind: T.DataType, value: str) -> Column:
    """Member of a comma-separated list."""
    items = [x.strip() for x in value.split(",")]
    if type(kind) in _BITS:
        known = [n for n in (_whole(kind, x) for x in items) if n is not None]
        return column.isin(*(F.lit(n).cast(kind) for n in known)) if known else _never()
    return (column if isinstance(kind, T.StringType) else column.cast("string")).isin(items)


OPERATORS = {"igual": equal, "menor": less, "entre": between, "en": within, "eq": equal, "lt": less, "between": between, "in": within}


def _rule(df: DataFrame, operator: str, field: str, value: str) -> Column:
    make = OPERATORS.get(operator.strip().lower())
    if make is None:
        raise ValueError(f"unknown operator: {operator!r}")
    kind = {f.name: f.dataType for f in df.schema.fields}.get(field)
    made = make(_column(field), kind or T.StringType(), value)  # a bad value is an error on an absent column, too
    return _never() if kind is None else made


def predicate(df: DataFrame, operator: str, field: str, value: str) -> Column:
    """The named predicate as a column of true and false; an unknown name is an error, an absent column gives false."""
    return F.coalesce(_rule(df, operator, field, value), F.lit(False))


def keep(df: DataFrame, *rules: tuple[str, str, str]) -> DataFrame:
    """Rows that pass all rules. A filter drops nulls by itself, so the rules stay bare and reach the scan."""
    for rule in rules:
        df = df.where(_rule(df, *rule))
    return df

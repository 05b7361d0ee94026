"""Column functions: identifiers, money, dates, hashes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency names and their ISO codes (fixed values).
CURRENCY_ISO = {
    "US Dollar": "USD",
    "Euro": "EUR",
    "UK Pound": "GBP",
    "Yen": "JPY",
    "Australian Dollar": "AUD",
    "Bitcoin": "BTC",
    "Brazil Real": "BRL",
    "Canadian Dollar": "CAD",
    "Mexican Peso": "MXN",
    "Ruble": "RUB",
    "Rupee": "INR",
    "Saudi Riyal": "SAR",
    "Shekel": "ILS",
    "Swiss Franc": "CHF",
    "Yuan": "CNY",
}
DIGITS = "^[0-9]+$"
LEADING_ZEROS = "^0+(?=.)"
MISSING = "N/A"


def key_part(c: Column) -> Column:
    """Trimmed text; null and blank become N/A."""
    trimmed = F.trim(c.cast("string"))
    return F.when(trimmed.isNull() | (trimmed == ""), MISSING).otherwise(trimmed)


def digits_id(c: Column) -> Column:
    """An identifier: all-digit ones lose leading zeros, null and blank become N/A."""
    part = key_part(c)
    return F.when(part.rlike(DIGITS), F.regexp_replace(part, LEADING_ZEROS, "")).otherwise(part)


def plain_id(c: Column) -> Column:
    """Any identifier without leading zeros; an empty one becomes 0."""
    stripped = F.regexp_replace(F.trim(c.cast("string")), LEADING_ZEROS, "")
    return F.when(stripped == "", "0").otherwise(stripped)


def bank_id(c: Column) -> Column:
    """All-digit bank ids without leading zeros, others as they are."""
    return F.when(c.rlike(DIGITS), F.regexp_replace(c, LEADING_ZEROS, "")).otherwise(c)


def int_or_text(c: Column) -> Column:
    """The integer's text if the value is one, else the value."""
    return F.coalesce(c.try_cast("bigint").cast("string"), c)


def number(c: Column) -> Column:
    """Double, or null for what is no number; never an error."""
    return c.try_cast("double")


def day(ts_text: Column) -> Column:
    """The date of ``yyyy/MM/dd HH:mm`` text; null if it is none."""
    return F.try_to_date(F.substring(ts_text, 1, 10), "yyyy/MM/dd")


def iso_code(currency: Column) -> Column:
    """ISO code of a currency name; null for an unknown one."""
    pairs = [F.lit(x) for pair in CURRENCY_ISO.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), currency)


def in_usd(amount: Column, iso: Column, rate: Column) -> Column:
    """Dollars stay; else amount / rate, null for a zero or missing rate."""
    return F.when(iso == "USD", amount).otherwise(amount / F.nullif(rate, F.lit(0.0)))


def md5_bucket(key: Column, n: int) -> Column:
    """1 + (MD5 as a 128-bit number) mod n, by Horner over four 32-bit pieces."""
    digest, step = F.md5(key.cast("binary")), (1 << 32) % n
    value = F.lit(0).cast("bigint")
    for at in (1, 9, 17, 25):
        value = (value * step + F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")) % n
    return (value + 1).cast("int")


def composite_key(*parts: Column, tenant: Column | None = None) -> Column:
    """Normalised parts joined by ``|``; no parts give ``default``; a tenant comes first."""
    key = F.concat_ws("|", *map(digits_id, parts)) if parts else F.lit("default")
    return F.concat_ws("|", tenant, key) if tenant is not None else key


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of MD5."""
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def session_of(request_id: Column) -> Column:
    """The second of the colon-separated parts; null if there is none."""
    return F.try_element_at(F.split(request_id, ":"), F.lit(2))


def query_number(name: Column) -> Column:
    """The number behind a q; null without one."""
    return F.regexp_extract(name, r"q(\d+)", 1).try_cast("int")


def cents(amount: Column) -> Column:
    """Whole cents, halves to even."""
    return F.bround(amount * 100).cast("bigint")


def days_between(first: Column, last: Column) -> Column:
    """An array of all days from first to last."""
    return F.sequence(first, last, F.expr("interval 1 day"))

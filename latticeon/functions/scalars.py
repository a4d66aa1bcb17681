"""Scalar functions by name, for the SQL binder and for direct use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, f"{_SPACE}+$", "")


def moment(c: Column) -> Column:
    """A timestamp from a timestamp or an RFC 3339 string; null if it is neither."""
    return F.try_to_timestamp(c.cast("string"))


_PARTS = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "QUARTER": F.quarter, "DOW": lambda c: F.dayofweek(c) - 1}
_UNITS = ("year", "quarter", "month", "day", "hour", "minute", "second")


def date_part(name: str, c: Column) -> Column:
    """A part in UTC; 0 if the value can't be read, null if it is null."""
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(_PARTS[name](moment(c)), F.lit(0))).cast("long")


def date_trunc(unit: str, c: Column) -> Column:
    if unit.lower() not in _UNITS:
        return c.cast("string")
    return F.date_format(F.date_trunc(unit.lower(), moment(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age(c: Column, seconds: int, now: Column | None = None) -> Column:
    """Whole units since an epoch in seconds or a yyyy-MM-dd date."""
    now = F.unix_timestamp() if now is None else now
    epoch = F.coalesce(F.expr("try_cast(NULL AS bigint)"), c.cast("string").try_cast("double"), F.unix_timestamp(F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd"))).cast("double"))
    return ((now - epoch) / seconds).cast("long")


def divide(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a.cast("double"), F.lit(0.0)), F.coalesce(b.cast("double"), F.lit(0.0))
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5: SHA-1 of the namespace's bytes and the name. A bad namespace means that of DNS."""
    try:
        ns = uuid.UUID(namespace)
    except ValueError:
        ns = uuid.NAMESPACE_DNS
    h = F.sha1(F.concat(F.unhex(F.lit(ns.hex)), F.encode(name.cast("string"), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def array_length(c: Column, dtype: str) -> Column:
    return F.json_array_length(c) if dtype == "string" else F.size(c).cast("int")


SIMPLE = {
    "LENGTH": lambda c: F.length(c), "LEN": lambda c: F.length(c), "LOWER": F.lower, "UPPER": F.upper,
    "TRIM": trim, "LTRIM": ltrim, "RTRIM": rtrim,
}
DATE_PARTS = tuple(_PARTS)

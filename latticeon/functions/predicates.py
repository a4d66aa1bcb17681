"""Two-valued predicates: a missing value makes a comparison false, and != true.

Literals compare by kind: numbers with numbers, strings with strings; a number
never equals a string. Order comparisons hold for numbers only.

``bare=True`` leaves out what makes a missing value false: a filter drops such a row in any case,
and only a bare comparison reaches the scan or becomes the key of a join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def matches_kind(dtype: T.DataType | None, v) -> bool:
    """May a column of this type equal such a literal?"""
    if dtype is None or v is None:
        return True
    if isinstance(dtype, T.NumericType):
        return is_number(v)
    if isinstance(dtype, T.BooleanType):
        return isinstance(v, bool)
    if isinstance(dtype, T.StringType):
        return isinstance(v, str)
    return True


def _made(c: Column, bare: bool) -> Column:
    return c if bare else sure(c)


def equal(c: Column, v, dtype: T.DataType | None = None, bare: bool = False) -> Column:
    if v is None:
        return c.isNull()
    return _made(c == F.lit(v), bare) if matches_kind(dtype, v) else F.lit(False)


def differs(c: Column, v, dtype: T.DataType | None = None) -> Column:
    if v is None:
        return c.isNotNull()
    return c.isNull() | (c != F.lit(v)) if matches_kind(dtype, v) else F.lit(True)


def compare(c: Column, op: str, v, dtype: T.DataType | None = None, bare: bool = False) -> Column:
    """op: one of = != < <= > >=."""
    if op == "=":
        return equal(c, v, dtype, bare)
    if op in ("!=", "<>"):
        return differs(c, v, dtype)
    if not is_number(v) or (dtype is not None and not isinstance(dtype, T.NumericType)):
        if not (isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(v, str)):
            return F.lit(False)
    right = F.lit(v)
    return _made({"<": c < right, "<=": c <= right, ">": c > right, ">=": c >= right}[op], bare)


def between(c: Column, low, high, dtype=None, bare: bool = False) -> Column:
    return compare(c, ">=", low, dtype, bare) & compare(c, "<=", high, dtype, bare)


def is_in(c: Column, values, dtype=None, bare: bool = False) -> Column:
    fit = [v for v in values if v is not None and matches_kind(dtype, v)]
    got = _made(c.isin(*fit), bare) if fit else F.lit(False)
    return got | c.isNull() if None in values else got


def not_in(c: Column, values, dtype=None) -> Column:
    fit = [v for v in values if v is not None and matches_kind(dtype, v)]
    if None in values:
        return c.isNotNull() & ~c.isin(*fit) if fit else c.isNotNull()
    return c.isNull() | ~c.isin(*fit) if fit else F.lit(True)


def array_contains_all(c: Column, values) -> Column:
    return sure(F.size(F.array_except(F.array(*[F.lit(v) for v in values]), c)) == 0)


def like(c: Column, pattern: str, ignore_case: bool = False, standard: bool = False) -> Column:
    """Unanchored by default: the parts between % must occur in order; _ is an ordinary character.

    standard=True gives SQL's LIKE.
    """
    if standard:
        return sure(c.ilike(pattern) if ignore_case else c.like(pattern))
    p = pattern.strip()
    if ignore_case:
        c, p = F.lower(c), p.lower()
    parts = [x for x in p.split("%") if x]
    if not parts:
        return c.isNotNull()
    if len(parts) == 1:
        return sure(F.contains(c, F.lit(parts[0])))
    return sure(c.rlike("(?s)" + ".*".join(r"\Q" + x.replace(r"\E", r"\E\\E\Q") + r"\E" for x in parts)))


def json_path(c: Column, keys, text: bool) -> Column:
    path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" if not re.fullmatch(r"\w+", k) else f".{k}" for k in keys)
    return F.get_json_object(c.cast("string"), path)

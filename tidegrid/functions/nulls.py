"""Null rules that differ between statistical scripts and SQL, in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_na_safe(cond: Column, then: Column, other: Column) -> Column:
    """Conditional that stays null when the condition is unknown."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, then).otherwise(other)


def in_set(c: str | Column, values) -> Column:
    """Membership test that is false, not null, for a missing value."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def sum_or_zero(c: str | Column) -> Column:
    """Sum that skips nulls and is 0 for a group without values."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def strict_sum(c: str | Column) -> Column:
    """Sum that is null as soon as one value of the group is null."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.sum(col(c)))


def later_of(a: str | Column, b: str | Column) -> Column:
    """Later of two values; null when either is null."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def n_distinct_with_null(c: str | Column) -> Column:
    """Distinct count in which a missing value counts as one more value."""
    c = col(c)
    return F.countDistinct(c) + F.max(c.isNull().cast("int"))


def row_sum(*cols: str | Column) -> Column:
    """Sum across columns, nulls as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])


def any_not_null(*cols: str | Column) -> Column:
    return reduce(lambda a, b: a | b, [col(c).isNotNull() for c in cols])


def all_not_null(*cols: str | Column) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cols])


def number_or_null(c: str | Column) -> Column:
    """Lossy text to number: text that is no number becomes null."""
    return col(c).try_cast("double")


def safe_divide(a: Column, b: Column) -> Column:
    """Quotient; null for a zero or missing divisor."""
    return F.when(b != 0, a / b)


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Contract on column names; looks at the schema only."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")
    return df

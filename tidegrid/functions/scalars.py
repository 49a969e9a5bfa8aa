"""Binning, look-ups by literal maps, text cleaning, composite keys, transforms."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import col


def find_interval(x: str | Column, bounds, left_open: bool = False) -> Column:
    """Number of bounds at or below ``x`` (strictly below when ``left_open``)."""
    x = col(x)
    hits = [((x > b) if left_open else (x >= b)).cast("int") for b in bounds]
    return reduce(lambda a, b: a + b, hits)


def cut_labels(x: str | Column, bounds, labels, left_open: bool = True) -> Column:
    """Label of the interval that holds ``x``; null outside the outer bounds."""
    idx = find_interval(x, bounds, left_open)
    inside = idx.between(1, len(bounds) - 1)
    return F.when(inside, F.element_at(F.array(*[F.lit(v) for v in labels]), idx))


# Latitude bands of the management regions, south to north.
REGION_BOUNDS = [32.5, 38.833, 42.0, 46.25, 50.0]
REGION_LABELS = ["CenCA", "NorCA", "OR", "WA"]
STATE_LABELS = ["CA", "CA", "OR", "WA"]


def region_of(lat: str | Column) -> Column:
    return cut_labels(lat, REGION_BOUNDS, REGION_LABELS)


def state_of(lat: str | Column) -> Column:
    return cut_labels(lat, REGION_BOUNDS, STATE_LABELS)


def recode(c: str | Column, mapping: dict, keep_other: bool = True) -> Column:
    """Replace by a small literal map; unlisted values stay or become null."""
    m = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    hit = F.try_element_at(m, col(c))
    return F.coalesce(hit, col(c)) if keep_other else hit


def dms_to_decimal(deg, minutes, decimal=None, negative: bool = False) -> Column:
    """Degrees and decimal minutes to degrees, only where no decimal value is given."""
    v = col(deg) + col(minutes) / 60.0
    v = -v if negative else v
    return v if decimal is None else F.coalesce(col(decimal), v)


def concat_key(*cols: str | Column, sep: str = "_") -> Column:
    """Composite key; null if a part is null, so that no false key arises."""
    parts = [col(c).cast("string") for c in cols]
    body = list(chain.from_iterable((F.lit(sep), p) for p in parts))[1:]
    return F.concat(*body)


def split_into(df: DataFrame, c: str, names: list[str], sep: str) -> DataFrame:
    """Split a text column into several; missing parts are null, extra parts dropped."""
    parts = F.split(F.col(c), sep)
    return df.withColumns({n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(names)})


def clean_text(c: str | Column) -> Column:
    """Strip blanks, squeeze inner blanks to one, capitalise words."""
    return F.initcap(F.regexp_replace(F.trim(col(c)), r"\s+", " "))


def map_columns(df: DataFrame, cols, f) -> DataFrame:
    """Apply one expression to many columns in a single projection."""
    return df.withColumns({c: f(F.col(c)) for c in cols})


def fourth_root(c: str | Column) -> Column:
    return F.pow(col(c), F.lit(0.25))


def two_sided_normal(z: Column) -> Column:
    """Probability of a standard normal value further from 0 than ``z``.

    The complementary error function by a published Chebyshev fit; the relative error stays below
    1.2e-7 however far out ``z`` lies.
    """
    # Published coefficients of the fit.
    a = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    x = F.abs(z) / (2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(a[-1])
    for c in reversed(a[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(poly - x * x)

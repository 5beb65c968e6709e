"""Numeric expressions: safe parsing, tolerances, spectra and image positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions import fixed
from stratalog.functions.text import _c


def _is_finite(v: Column) -> Column:
    x = v.cast("double")
    return v.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite(value: str | Column) -> Column:
    """Finite double, or null."""
    x = _c(value).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def measured(value: str | Column) -> Column:
    """Finite double with the scanner's absent-value sentinel as null."""
    x = finite(value)
    return F.when(x > fixed.FLOAT32_MIN / 1e10, x)


def decimal_close(a: str | Column, b: str | Column, tolerance: str = "0.00001") -> Column:
    """Difference of the decimal texts within a decimal tolerance, free of binary rounding."""
    exact = lambda c: _c(c).cast("string").try_cast("decimal(28,10)")
    # beyond what the decimal holds only equality is certain
    return F.coalesce(F.abs(exact(a) - exact(b)) <= F.lit(tolerance).cast("decimal(28,10)"), _c(a) == _c(b))


def same_float32(a: str | Column, b: str | Column) -> Column:
    """Both finite as float32 and equal there, signed zeros kept apart."""
    x, y = _c(a).cast("float"), _c(b).cast("float")
    bounded = _is_finite(x) & _is_finite(y)
    # the text of a zero keeps its sign, equality does not
    return bounded & (x == y) & (x.cast("string") == y.cast("string"))


@F.pandas_udf(T.BooleanType())
def equal_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Float32 vectors with identical bits; NaN payloads and signed zeros count."""

    def same(x, y):
        if x is None or y is None:
            return None
        return np.asarray(x, "<f4").tobytes() == np.asarray(y, "<f4").tobytes()

    return pd.Series([same(x, y) for x, y in zip(a, b)], dtype=object)


def spectral_region(wavelengths: str | Column, unit: str | Column, other: str | None = None) -> Column:
    """VSWIR for 380-2500 nm, TIR for 6000-14500 nm, else ``other``."""
    waves = _c(wavelengths)
    low, high = F.array_min(waves), F.array_max(waves)
    nm = _c(unit) == "nm"
    return (
        F.when(nm & (low == 380) & (high == 2500), F.lit("VSWIR"))
        .when(nm & (low == 6000) & (high == 14500), F.lit("TIR"))
        .otherwise(F.lit(other).cast("string"))
    )


def image_position(sample: str | Column, first: str | Column, last: str | Column) -> Column:
    """Relative place of a sample on its image row: 0 and 1 at the ends, 0.5 for a single sample."""
    s, a, b = (_c(x).cast("double") for x in (sample, first, last))
    inside = (a >= 0) & (a <= s) & (s <= b)
    return F.when(inside, F.when(b > a, (s - a) / (b - a)).otherwise(F.lit(0.5)))


def image_pixel(sample, first, last, width) -> Column:
    return image_position(sample, first, last) * (_c(width) - 1)


def finite_channels(values: str | Column) -> Column:
    """The array with NaN and infinite channels as null."""
    return F.transform(_c(values), lambda v: F.when(_is_finite(v), v))


def nonfinite_channels(values: str | Column) -> Column:
    """0-based positions of the channels that are not finite."""
    marked = F.transform(_c(values), lambda v, i: F.when(~_is_finite(v), i))
    return F.filter(marked, lambda i: i.isNotNull())


def positive_minimum(values: str | Column) -> Column:
    """Smallest strictly positive value, 0 when there is none."""
    return F.coalesce(F.array_min(F.filter(_c(values), lambda v: v > 0)), F.lit(0.0))


def strictly_increasing(values: str | Column) -> Column:
    array = _c(values)
    steps = F.greatest(F.size(array) - 1, F.lit(1))
    pairs = F.zip_with(F.slice(array, F.lit(1), steps), F.slice(array, F.lit(2), steps), lambda a, b: b > a)
    return F.forall(array, _is_finite) & ((F.size(array) < 2) | F.forall(pairs, lambda ok: ok))

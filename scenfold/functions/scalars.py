"""Scalar column functions (SCA-*)."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, ShortType

#: EJ to TWh is ``/ 3.6 * 1000``.
EJ_PER_PWH = 3.6


def null_if_nan(col: Column | str) -> Column:
    """NaN -> NULL, so sums and means skip missing values."""
    return F.nanvl(col, F.lit(None).cast("double"))


def scale(col: Column | str, factor: float) -> Column:
    """SCA-1: unit scaling by a constant."""
    return F.col(col) * F.lit(float(factor)) if isinstance(col, str) else col * F.lit(float(factor))


def ej_to_twh(col: Column | str) -> Column:
    """SCA-1: energy in EJ to electricity in TWh."""
    value = F.col(col) if isinstance(col, str) else col
    return value / F.lit(EJ_PER_PWH) * F.lit(1000.0)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """SCA-2: division that gives NULL on a zero denominator."""
    return F.try_divide(a, b)


def to_year(col: Column | str, dtype: DataType | None = None) -> Column:
    """SCA-3: label or number to integer year, NULL where it is not a whole number.

    Labels may be written as decimals (``2020.0``). An integer column is returned untouched so that
    range filters still reach the scan.
    """
    col = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (IntegerType, LongType, ShortType)):
        return col
    number = col.try_cast("double")
    return F.when(number == F.rint(number), number.try_cast("int"))


def lookup(col: Column | str, mapping: Mapping[str, Any]) -> Column:
    """SCA-4: map lookup, NULL for a label that is not in the map."""
    literals = [F.lit(x) for x in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*literals), F.col(col) if isinstance(col, str) else col)


def zero_if_null(col: Column | str) -> Column:
    """SCA-5: missing -> 0."""
    return F.coalesce(col, F.lit(0.0))


def pos(col: Column | str) -> Column:
    """SCA-6: positive part, 0 where missing."""
    return F.greatest(zero_if_null(col), F.lit(0.0))


def neg(col: Column | str) -> Column:
    """SCA-6: negative part, 0 where missing."""
    return F.least(zero_if_null(col), F.lit(0.0))


def label(col: Column | str) -> Column:
    """SCA-8: number to label."""
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def key(scenario: Column | str, year: Column | str) -> Column:
    """SCA-7: the ``Scenario-Year`` bar key."""
    return F.concat_ws("-", scenario, label(year))


def negate(col: Column | str) -> Column:
    """SCA-9: flip the sign of a flow."""
    return -(F.col(col) if isinstance(col, str) else col)


def product(a: Column | str, b: Column | str) -> Column:
    """SCA-11: NULL-propagating product of two columns."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a * b

"""Filters (FIL-*). Plain predicates on columns, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenfold.functions.scalars import to_year
from scenfold.model import TIME

#: Values of a dimension argument that mean "no filter".
WILDCARDS = ("global", "all", None)

Value = str | Sequence[str] | None


def as_list(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def is_open(value: Value) -> bool:
    """True for a wildcard argument."""
    return value is None or (isinstance(value, str) and value in WILDCARDS)


def one_or_many(value: Value) -> Value:
    """A dimension argument in one spelling: ``all`` for any wildcard, the label for a list of one."""
    if is_open(value):
        return "all"
    wanted = list(dict.fromkeys(as_list(value)))
    return wanted[0] if len(wanted) == 1 else wanted


def eq(df: DataFrame, col: str, value: str) -> DataFrame:
    """FIL-1: one label of a dimension."""
    return df.filter(F.col(col) == F.lit(value))


def isin(df: DataFrame, col: str, values: Sequence[str] | DataFrame) -> DataFrame:
    """FIL-2: membership, as one predicate (a hash set) of a list that the caller holds.

    Labels in a frame, those of its only column, are a left semi-join: repeats and nulls in them do not matter, and Spark
    chooses by size how to join, and whether a Bloom filter of the labels thins the rows out before they are shuffled.
    """
    if isinstance(values, DataFrame):
        labels = values.toDF("__label")
        return df.join(labels, F.col(col) == F.col("__label"), "left_semi")
    return df.filter(F.col(col).isin(list(values)))


def horizon(df: DataFrame, limit: int, col: str = TIME) -> DataFrame:
    """FIL-3, FIL-6: years up to ``limit``; missing or non-numeric years drop out."""
    return df.filter(to_year(col, df.schema[col].dataType) <= F.lit(limit))


def time_range(df: DataFrame, col: str, start: int, end: int) -> DataFrame:
    """SRC-8: coerce the year to integer and keep ``start..end``, both included."""
    year = to_year(col, df.schema[col].dataType)
    return df.filter(year.between(start, end)).withColumn(col, year.cast("int"))


def years(df: DataFrame, wanted: Sequence[int] | None, col: str = TIME) -> DataFrame:
    """FIL-7: explicit years; an empty list keeps all."""
    return df.filter(F.col(col).isin(list(wanted))) if wanted else df


def region(df: DataFrame, value: Value, col: str = "R") -> DataFrame:
    """FIL-8: one region, a list of regions, or a wildcard."""
    return filter_dims(df, **{col: value})


def filter_dims(df: DataFrame, **dims: Value) -> DataFrame:
    """FIL-4, FIL-5: one predicate per dimension argument; wildcards add none."""
    predicate = dims_predicate(**dims)
    return df if predicate is None else df.filter(predicate)


def dims_predicate(**dims: Value) -> Column | None:
    predicate = None
    for col, value in dims.items():
        if is_open(value):
            continue
        wanted = as_list(value)
        term = F.col(col) == F.lit(wanted[0]) if len(wanted) == 1 else F.col(col).isin(wanted)
        predicate = term if predicate is None else predicate & term
    return predicate

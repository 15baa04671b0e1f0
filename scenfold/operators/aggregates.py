"""Aggregations (AGG-*).

All are single ``groupBy`` plans: Spark pre-aggregates on the map side, so a hot key costs one
partial row per task rather than a hot reducer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scenfold.model import SCENARIO, TIME, VALUE
from scenfold.operators.filters import Value, is_open


def total(value: Column | str = VALUE) -> Column:
    """Sum that skips missing values and gives 0 for a group of only missing values."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def agg_sum(df: DataFrame, keys: Sequence[str], value: str = VALUE) -> DataFrame:
    """AGG-1."""
    return df.groupBy(*keys).agg(total(value).alias(value))


def agg_mean(df: DataFrame, keys: Sequence[str], value: str = VALUE) -> DataFrame:
    """AGG-2: NULL for a group of only missing values."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def agg_by_type(df: DataFrame, keys: Sequence[str], kind: str, value: str = VALUE) -> DataFrame:
    """AGG-3: prices are averaged, everything else is summed."""
    return agg_mean(df, keys, value) if kind == "price" else agg_sum(df, keys, value)


def factor_mean(
    factors: DataFrame, keys: Sequence[str] = (SCENARIO,), value: str = VALUE
) -> DataFrame:
    """AGG-4: mean factor per scenario over all its regions."""
    return agg_mean(factors, keys, value)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """AGG-5: the distinct labels of some columns, as a frame."""
    return df.select(*cols).distinct()


def distinct_count(df: DataFrame, *cols: str) -> DataFrame:
    """AGG-5: one row with the number of distinct labels per column."""
    return df.agg(*[F.countDistinct(c).alias(c) for c in cols])


def open_dims(dims: Mapping[str, Value]) -> list[str]:
    """AGG-6: the dimensions an ``'all'`` argument leaves open."""
    return [col for col, value in dims.items() if isinstance(value, str) and value == "all"]


def agg_open_dims(
    df: DataFrame,
    dims: Mapping[str, Value],
    keys: Sequence[str] = (SCENARIO, TIME),
    value: str = VALUE,
) -> DataFrame:
    """AGG-6: sum by scenario, year and the dimensions left open."""
    return agg_sum(df, [*keys, *open_dims(dims)], value)


def with_total(
    df: DataFrame, keys: Sequence[str] = (SCENARIO, TIME), value: str = VALUE, name: str = "total"
) -> DataFrame:
    """AGG-7: each row with the total of its (scenario, year).

    Expects one row per series, as ``agg_sum`` leaves it: the window then spans the series of one
    chart bar.
    """
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys)))


def row_total(
    df: DataFrame, keys: Sequence[str] = (SCENARIO, TIME), value: str = VALUE
) -> DataFrame:
    """AGG-7 on its own: the total per key."""
    return agg_sum(df, keys, value)


def series_total(df: DataFrame, series: str, value: str = VALUE) -> DataFrame:
    """AGG-8: total per series over all bars."""
    return agg_sum(df, [series], value)


__all__ = [
    "agg_by_type", "agg_mean", "agg_open_dims", "agg_sum", "distinct_count", "distinct_values",
    "factor_mean", "is_open", "open_dims", "row_total", "series_total", "total", "with_total",
]

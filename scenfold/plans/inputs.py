"""Intermediate inputs (N-25, N-26)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from scenfold.functions.scalars import scale
from scenfold.model import SCENARIO, TIME, VALUE, YEAR
from scenfold.operators.aggregates import agg_sum
from scenfold.operators.filters import Value, filter_dims, horizon as until
from scenfold.operators.reshape import pivot_sum

#: Model unit (10 billion dollars) to billion dollars.
INPUT_SCALE = 10.0


def inputs(
    catalog: Mapping[str, DataFrame],
    sector: Value = None,
    commodity: Value = None,
    region: Value = "global",
    horizon: int = 2100,
) -> DataFrame:
    """N-25: input flows by scenario and year; sector and commodity filter when given."""
    df = filter_dims(until(catalog["AAI"], horizon), G=sector, ne=commodity, R=region)
    return agg_sum(df.withColumn(VALUE, scale(VALUE, INPUT_SCALE)), [SCENARIO, TIME])


def inputs_breakdown(
    catalog: Mapping[str, DataFrame],
    sector: str,
    region: Value = "global",
    horizon: int = 2100,
    *,
    wide: Sequence[str] | None = None,
) -> DataFrame:
    """N-26: a sector's inputs by scenario, year and commodity. ``wide`` lists the commodities."""
    df = filter_dims(until(catalog["AAI"], horizon), G=sector, R=region)
    df = df.withColumn(VALUE, scale(VALUE, INPUT_SCALE)).withColumnRenamed(TIME, YEAR)
    if wide is not None:
        return pivot_sum(df, [SCENARIO, YEAR], "ne", wide)
    return agg_sum(df, [SCENARIO, YEAR, "ne"])

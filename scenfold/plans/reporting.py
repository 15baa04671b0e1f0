"""Analyses of the reporting table (N-15..N-20, N-24).

All are one template: attribute set -> label -> scale -> one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from scenfold.functions.scalars import scale
from scenfold.metadata import DEFAULT, ModelMetadata
from scenfold.model import SCENARIO, VALUE, YEAR
from scenfold.operators.aggregates import agg_mean, agg_sum
from scenfold.operators.filters import Value, eq, filter_dims, horizon as until, is_open, isin
from scenfold.operators.projections import relabel
from scenfold.operators.reshape import pivot_sum, widened


def attribute_profile(
    table: DataFrame,
    series: Mapping[str, tuple],
    region: Value = "global",
    horizon: int = 2100,
    *,
    factor: float = 1.0,
    wide: bool = True,
) -> DataFrame:
    """Sum a set of attributes by scenario, year and label.

    Wide frames carry the labels in metadata order; an attribute the data lacks is a NULL column.
    """
    df = filter_dims(until(isin(table, "Attribute", list(series)), horizon, YEAR), Region=region)
    labels = {attribute: style[0] for attribute, style in series.items()}
    df = relabel(df, "Attribute", labels).withColumnRenamed("Attribute", "Series")
    if factor != 1.0:
        df = df.withColumn(VALUE, scale(VALUE, factor))
    if wide:
        return pivot_sum(df, [SCENARIO, YEAR], "Series", list(dict.fromkeys(labels.values())))
    return agg_sum(df, [SCENARIO, YEAR, "Series"])


def emissions(
    table: DataFrame, region: Value = "global", horizon: int = 2100, *,
    wide: bool = True, meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-15: emissions profile in GtCO2eq."""
    return attribute_profile(
        table, meta.emission_series, region, horizon, factor=1 / 1000, wide=wide
    )


def primary_energy(
    table: DataFrame, region: Value = "global", horizon: int = 2100, *,
    wide: bool = True, meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-17: primary energy in EJ."""
    return attribute_profile(table, meta.primary_energy_series, region, horizon, wide=wide)


def electricity(
    table: DataFrame, region: Value = "global", horizon: int = 2100, *,
    wide: bool = True, meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-18: electricity generation in TWh."""
    return attribute_profile(table, meta.electricity_series, region, horizon, wide=wide)


def emission_price(
    table: DataFrame, kind: str, horizon: int = 2100, *, wide: bool = False,
    values: Sequence[str] | None = None, meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-16: CO2 (``co2``) or GHG (``ghg``) price, averaged over regions.

    ``wide`` gives one column per scenario, those of ``values`` or all.
    """
    if kind not in meta.price_attributes:
        raise ValueError(f"kind must be one of {sorted(meta.price_attributes)}, not {kind!r}")
    df = eq(until(table, horizon, YEAR), "Attribute", meta.price_attributes[kind])
    return widened(agg_mean(df, [SCENARIO, YEAR]), wide, SCENARIO, values, [YEAR])


def gdp(
    table: DataFrame, by: str = "scenario", region: Value = "global", horizon: int = 2100, *,
    wide: bool = False, values: Sequence[str] | None = None, meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-19, N-20: GDP in trillion dollars by scenario, or by scenario and region name.

    ``region`` applies to the first form only. ``wide`` gives one column per scenario, or per region
    name; ``values`` are their labels.
    """
    df = eq(until(table, horizon, YEAR), "Attribute", meta.gdp_attribute)
    df = df.withColumn(VALUE, scale(VALUE, 1 / 1000))
    if by == "scenario":
        df = agg_sum(filter_dims(df, Region=region), [SCENARIO, YEAR])
        return widened(df, wide, SCENARIO, values, [YEAR])
    if by == "region":
        df = relabel(agg_sum(df, [SCENARIO, YEAR, "Region"]), "Region", meta.region_names)
        return widened(df, wide, "Region", values)
    raise ValueError("by must be 'scenario' or 'region'")


def attribute(
    table: DataFrame, name: str, region: Value = "global", horizon: int = 2100
) -> DataFrame:
    """N-24: one attribute by scenario and year, summed over regions or averaged for one."""
    df = filter_dims(eq(until(table, horizon, YEAR), "Attribute", name), Region=region)
    return agg_sum(df, [SCENARIO, YEAR]) if is_open(region) else agg_mean(df, [SCENARIO, YEAR])


def scenario_columns(df: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """A (scenario, year) result with one column per scenario."""
    return pivot_sum(df, [YEAR], SCENARIO, scenarios)


__all__ = [
    "attribute", "attribute_profile", "electricity", "emission_price", "emissions", "gdp",
    "primary_energy", "scenario_columns",
]

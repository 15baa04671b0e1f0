"""Parameter comparison (N-1, N-2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from scenfold.functions.scalars import scale
from scenfold.metadata import DEFAULT, ModelMetadata
from scenfold.model import SCENARIO, TIME, VALUE
from scenfold.operators.aggregates import agg_by_type, agg_mean
from scenfold.operators.compare import REFERENCE, rebase, reldiff
from scenfold.operators.filters import Value, filter_dims, horizon as until, is_open, years as only_years
from scenfold.operators.joins import convert
from scenfold.operators.reshape import pivot_mean
from scenfold.sources.storage import cut

#: Symbols measured in output value, which tonnage sectors convert.
OUTPUT_SYMBOLS = ("agy", "agy_bt")


def grt_rows(
    catalog: Mapping[str, DataFrame],
    attr: str,
    sector: Value,
    region: Value = "global",
    horizon: int = 2100,
    *,
    meta: ModelMetadata = DEFAULT,
    strict: bool = False,
) -> DataFrame:
    """The rows N-1 aggregates: filtered, scaled, and divided by the region's tonnage factor."""
    df = filter_dims(until(catalog[attr], horizon), G=sector, R=region)
    df = df.select(SCENARIO, TIME, "G", "R", scale(VALUE, meta.converter(attr)).alias(VALUE))
    if attr in OUTPUT_SYMBOLS and isinstance(sector, str) and sector in meta.conversion:
        df = convert(df, meta.conversion[sector], strict=strict)
    return df


def is_averaged(attr: str, region: Value = "global", *, meta: ModelMetadata = DEFAULT) -> bool:
    """Prices are averaged over regions; for one region, duplicate rows are."""
    return not is_open(region) or meta.parameter_type(attr) == "price"


def grt(
    catalog: Mapping[str, DataFrame],
    attr: str,
    sector: Value,
    region: Value = "global",
    horizon: int = 2100,
    *,
    meta: ModelMetadata = DEFAULT,
    strict: bool = False,
) -> DataFrame:
    """N-1: a parameter of one sector by scenario and year.

    Output of a tonnage sector is divided by its region's factor first, so the global figure is a
    sum of converted values.
    """
    rows = grt_rows(catalog, attr, sector, region, horizon, meta=meta, strict=strict)
    keys = [SCENARIO, TIME]
    if is_averaged(attr, region, meta=meta):
        return agg_mean(rows, keys)
    return agg_by_type(rows, keys, meta.parameter_type(attr))


def compare(
    df: DataFrame,
    *,
    years: Sequence[int] | None = None,
    index: bool = False,
    relative: bool = False,
    ref: str = REFERENCE,
    time: str = TIME,
) -> DataFrame:
    """Explicit years, then rebase, then difference from the reference, each if asked for.

    A frame that is compared is computed once and checkpointed.
    """
    df = only_years(df, years, time)
    if index or relative:
        df = cut(df)
    if index:
        df = rebase(df, time=time)
    if relative:
        df = reldiff(df, ref, by=(time,))
    return df


def grt_compare(
    catalog: Mapping[str, DataFrame],
    attr: str,
    sector: Value,
    region: Value = "global",
    horizon: int = 2100,
    *,
    years: Sequence[int] | None = None,
    index: bool = False,
    relative: bool = False,
    ref: str = REFERENCE,
    wide: Sequence[str] | None = None,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-2: N-1 compared across scenarios. ``wide`` lists the scenarios to pivot to columns."""
    df = compare(
        grt(catalog, attr, sector, region, horizon, meta=meta),
        years=years, index=index, relative=relative, ref=ref,
    )
    if wide is None:
        return df
    return pivot_mean(df, [TIME], SCENARIO, [s for s in wide if not (relative and s == ref)])


def axis_label(attr: str, *, index: bool = False, relative: bool = False, meta: ModelMetadata = DEFAULT) -> str:
    """The value-axis label of a comparison."""
    axis, _, _, unit, kind = meta.parameters[attr]
    if relative:
        return "% difference vs reference"
    if index:
        return f"{axis} Index=100"
    return axis if kind == "price" else f"{axis} in {unit}"


__all__ = [
    "OUTPUT_SYMBOLS", "axis_label", "compare", "grt", "grt_compare", "grt_rows", "is_averaged",
]

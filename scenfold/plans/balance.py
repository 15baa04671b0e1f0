"""Supply and demand (N-27, N-28)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from scenfold.functions.scalars import negate
from scenfold.metadata import SUPPLY_FLOWS
from scenfold.model import SCENARIO, YEAR
from scenfold.operators.aggregates import agg_mean, agg_sum
from scenfold.operators.compare import REFERENCE, rebase, reldiff
from scenfold.operators.filters import Value, filter_dims, horizon as until, years as only_years
from scenfold.operators.reshape import pivot_mean
from scenfold.sources.storage import cut


def _selected(
    catalog: Mapping[str, DataFrame], sector: Value, region: Value,
    comm: Sequence[str] | None, flow: Sequence[str] | None,
    horizon: int, years: Sequence[int] | None,
) -> DataFrame:
    df = only_years(until(catalog["sd"], horizon, YEAR), years, YEAR)
    return filter_dims(df, Sector=sector, Region=region, comm=comm or None, flow=flow or None)


def supply_demand(
    catalog: Mapping[str, DataFrame],
    sector: Value,
    region: Value,
    *,
    comm: Sequence[str] | None = ("supply", "demand"),
    flow: Sequence[str] | None = SUPPLY_FLOWS,
    years: Sequence[int] | None = None,
    index: bool = False,
    relative: bool = False,
    ref: str = REFERENCE,
    agg: str = "mean",
    horizon: int = 2100,
) -> DataFrame:
    """N-27: the selected rows by scenario and year, indexed or relative to the reference.

    The selected rows are averaged; ``agg='sum'`` adds them up. ``index`` wins over ``relative``.
    """
    rows = _selected(catalog, sector, region, comm, flow, horizon, years)
    df = (agg_sum if agg == "sum" else agg_mean)(rows, [SCENARIO, YEAR])
    if index:
        return rebase(cut(df), time=YEAR)
    return reldiff(cut(df), ref, by=(YEAR,)) if relative else df


def supply_demand_flows(
    catalog: Mapping[str, DataFrame],
    sector: Value,
    region: Value,
    *,
    comm: Sequence[str] | None = ("supply", "demand"),
    flow: Sequence[str] | None = SUPPLY_FLOWS,
    years: Sequence[int] | None = None,
    horizon: int = 2100,
) -> DataFrame:
    """N-28: one column per flow by scenario and year, averaged, with exports negative."""
    rows = _selected(catalog, sector, region, comm, flow, horizon, years)
    wide = pivot_mean(rows, [SCENARIO, YEAR], "flow", SUPPLY_FLOWS)
    return wide.withColumn("exports", negate("exports"))


__all__ = ["supply_demand", "supply_demand_flows"]

"""Bilateral trade (N-10..N-14).

Rows name an importer ``R`` and an exporter ``RR``; a row with ``R = RR`` counts in both
directions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenfold.metadata import DEFAULT, ModelMetadata
from scenfold.model import SCENARIO, TIME, VALUE, YEAR
from scenfold.operators.aggregates import agg_sum
from scenfold.operators.compare import REFERENCE, rebase, reldiff, row_share, scenario_diff
from scenfold.operators.filters import Value, as_list, eq, horizon as until, is_open
from scenfold.operators.projections import relabel
from scenfold.operators.reshape import widened
from scenfold.sources.storage import cut

FLOWS = ("imports", "exports")


def _flows(df: DataFrame, sides: Sequence[Column]) -> DataFrame:
    """Each row once per side it belongs to, as (partner, signed value): one scan, no self-join."""
    side = F.explode(F.filter(F.array(*sides), lambda s: s.isNotNull()))
    return df.select(SCENARIO, YEAR, side.alias("__side")).select(SCENARIO, YEAR, "__side.*")


def _among(col: str, region: Value) -> Column:
    """Is the column one of the regions? A wildcard means any."""
    return F.col(col).isNotNull() if is_open(region) else F.col(col).isin(as_list(region))


def _side(own: str, partner: str, region: Value, sign: int) -> Column:
    """The row as seen from ``region`` in column ``own``; NULL when it does not take part."""
    value = F.col(VALUE) if sign > 0 else -F.col(VALUE)
    return F.when(
        _among(own, region), F.struct(F.col(partner).alias("Region"), value.alias(VALUE))
    )


def region_flows(
    catalog: Mapping[str, DataFrame],
    sector: str,
    region: Value,
    flow: str,
    *,
    net: bool = False,
    horizon: int = 2100,
) -> DataFrame:
    """A region's rows in one direction, or signed in both, as (Scenario, Year, Region, Value)."""
    if flow not in FLOWS:
        raise ValueError(f"unknown flow {flow!r}, choose from {FLOWS}")
    df = eq(until(catalog["trad_t"], horizon), "G", sector).withColumnRenamed(TIME, YEAR)
    own, partner = ("R", "RR") if flow == "imports" else ("RR", "R")
    if not net:
        return df.filter(_among(own, region)).select(SCENARIO, YEAR, F.col(partner).alias("Region"), VALUE)
    involved = _among("R", region) | _among("RR", region)
    return _flows(
        df.filter(involved),
        [_side(own, partner, region, 1), _side(partner, own, region, -1)],
    )


def trade_by_region(
    catalog: Mapping[str, DataFrame],
    sector: str,
    region: Value,
    flow: str,
    *,
    net: bool = False,
    percent: bool = False,
    difference: Sequence[str] | bool = False,
    wide: bool = False,
    values: Sequence[str] | None = None,
    horizon: int = 2100,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-10, N-11, N-13, N-14: trade by scenario, year and partner region.

    ``percent`` gives partner shares. ``difference`` gives the first scenario minus the second:
    pass the two names in registry order, or True when the data holds exactly two. ``wide`` gives
    one column per region name, those of ``values`` or else all that the metadata knows.
    """
    df = agg_sum(
        region_flows(catalog, sector, region, flow, net=net, horizon=horizon),
        [SCENARIO, YEAR, "Region"],
    )
    if percent:
        df = row_share(df, 100.0, keys=(SCENARIO, YEAR))
    df = relabel(df, "Region", meta.region_names)
    if difference:
        pair = None if difference is True else list(difference)
        df = scenario_diff(df, pair, keys=(YEAR, "Region"))
    keys = [c for c in (SCENARIO, YEAR) if c in df.columns]
    names = dict.fromkeys(meta.region_names.values()) if values is None else values
    return widened(df, wide, "Region", list(names), keys)


def trade_by_scenario(
    catalog: Mapping[str, DataFrame],
    sector: str,
    region: Value,
    flow: str,
    *,
    net: bool = False,
    relative: bool = False,
    index: bool = False,
    world: bool = False,
    one_way: bool = False,
    ref: str = REFERENCE,
    horizon: int = 2100,
) -> DataFrame:
    """N-12: trade by scenario and year, optionally relative to the reference, then indexed.

    ``world=True`` sums the whole sector whatever the region. ``one_way`` indexes the flow itself even
    where ``net`` asks for the balance, which may start at zero or below.
    """
    net = net and not (one_way and index)
    if world and not net:
        rows = eq(until(catalog["trad_t"], horizon), "G", sector).withColumnRenamed(TIME, YEAR)
    else:
        rows = region_flows(catalog, sector, region, flow, net=net, horizon=horizon)
    df = agg_sum(rows, [SCENARIO, YEAR])
    if relative or index:
        df = cut(df)
    if relative:
        df = reldiff(df, ref, by=(YEAR,))
    if index:
        df = rebase(df, time=YEAR)
    return df

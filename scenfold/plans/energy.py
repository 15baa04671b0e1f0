"""Energy balances (N-21..N-23)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenfold.functions.scalars import ej_to_twh, product
from scenfold.metadata import DEFAULT, ModelMetadata
from scenfold.model import SCENARIO, TIME, VALUE, YEAR
from scenfold.operators.aggregates import agg_open_dims
from scenfold.operators.compare import row_share
from scenfold.operators.filters import (
    Value, as_list, eq, filter_dims, horizon as until, is_open, isin, one_or_many,
)
from scenfold.operators.joins import union_all, with_factor
from scenfold.operators.projections import relabel, tag
from scenfold.operators.reshape import pivot_auto

# What refined oil is called in two sectors.
REFINED_OIL_NAMES = {"steel": "coke", "cement": "petroleum products"}

_COLUMNS = (SCENARIO, TIME, "G", "R", "e", VALUE)


def _to_energy(df: DataFrame, factors: DataFrame, carrier: str) -> DataFrame:
    """Value times the carrier's energy factor of its scenario and region."""
    factor = eq(factors, "G", carrier).select(SCENARIO, "R", VALUE)
    return with_factor(df, factor).withColumn(VALUE, product(VALUE, "factor"))


def carrier_labels(sector: Value = "all", *, meta: ModelMetadata = DEFAULT) -> dict[str, str]:
    """Names of carriers; refined oil is called by what the sector burns."""
    names = {code: entry[3] for code, entry in meta.sectors.items() if entry[3]}
    refined = REFINED_OIL_NAMES.get(_role(one_or_many(sector), meta))
    return names | ({meta.refined_oil: refined} if refined else {})


def _role(sector: Value, meta: ModelMetadata) -> str | None:
    return {meta.steel: "steel", meta.cement: "cement"}.get(sector) if isinstance(sector, str) else None


def energy_rows(
    catalog: Mapping[str, DataFrame],
    sector: Value,
    region: Value,
    energy: Value,
    horizon: int = 2100,
    *,
    primary: bool = False,
    exports: bool = False,
    export_factor: str | None = None,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """The rows an energy balance sums: sector use, self-use and exports of carriers."""
    sector, region, energy = map(one_or_many, (sector, region, energy))
    use = filter_dims(until(catalog["ee_sect"], horizon), G=sector, R=region, e=energy)
    if sector == "all" and not primary:
        use = isin(use, "G", meta.final_use_sectors)
    if sector == meta.steel and is_open(energy):
        use = use.filter(F.col("e") != meta.crude_oil)
    parts = [use.select(*_COLUMNS)]

    for carrier in () if is_open(energy) else as_list(energy):
        if carrier in meta.self_use_carriers:
            own = filter_dims(until(catalog["ee_add"], horizon), G=sector, R=region, e=carrier)
            parts.append(_to_energy(own, catalog["ejoe"], carrier).select(*_COLUMNS))

    if exports:
        if is_open(energy) or not isinstance(energy, str):
            raise ValueError("exports need one energy carrier")
        sold = tag(filter_dims(until(catalog["expo_t"], horizon), G=energy, R=region), "G", "Exports")
        sold = _to_energy(tag(sold, "e", energy), catalog["ejoe"], export_factor or energy)
        parts.append(sold.select(*_COLUMNS))

    return union_all(*parts)


def energy_use(
    catalog: Mapping[str, DataFrame],
    sector: Value,
    region: Value,
    energy: Value,
    horizon: int = 2100,
    *,
    percent: bool = False,
    primary: bool = False,
    exports: bool = False,
    export_factor: str | None = None,
    wide: bool = False,
    values: Sequence[str] | None = None,
    labels: bool = False,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-21..N-23: energy by scenario, year and every dimension passed as ``'all'``.

    Over all sectors only the final-use ones count, unless ``primary``. Carriers with self-use
    add it; ``exports`` adds the carrier's exports as sector ``Exports``. Electricity is in TWh,
    everything else in EJ. ``percent`` gives shares per scenario and year. ``wide`` pivots on the
    first of carrier, sector and region that varies; ``values`` are its labels. ``labels`` names
    carriers and sectors instead of giving their codes (``carrier_labels``).
    """
    sector, region, energy = map(one_or_many, (sector, region, energy))
    dims = {"R": region, "G": sector, "e": energy}
    rows = energy_rows(
        catalog, sector, region, energy, horizon,
        primary=primary, exports=exports, export_factor=export_factor, meta=meta,
    )
    df = agg_open_dims(rows, dims).withColumnRenamed(TIME, YEAR)
    if energy == meta.electricity:
        df = df.withColumn(VALUE, ej_to_twh(VALUE))
    if percent:
        df = row_share(df, 100.0, keys=(SCENARIO, YEAR))
    if labels and "e" in df.columns:
        df = relabel(df, "e", carrier_labels(sector, meta=meta))
    if labels and "G" in df.columns:
        df = relabel(df, "G", {code: entry[1] for code, entry in meta.sectors.items()})
    return pivot_auto(df, [SCENARIO, YEAR], values=values) if wide else df

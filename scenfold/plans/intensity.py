"""Emission intensity by scope (N-3..N-9).

Every quantity an intensity needs is a (Scenario, t) part; all parts go through one
``side_by_side`` aggregate, and the scopes are then column arithmetic on its rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenfold.functions.scalars import lookup, product, safe_div, zero_if_null
from scenfold.metadata import DEFAULT, ModelMetadata
from scenfold.model import SCENARIO, TIME, VALUE, YEAR
from scenfold.operators.aggregates import factor_mean
from scenfold.operators.filters import Value, eq, filter_dims, horizon as until, is_open
from scenfold.operators.joins import first_by, parts_of, side_by_side
from scenfold.plans.mixes import liquids_mix
from scenfold.plans.parameters import grt_rows

#: Parts that are model parameters of one sector (N-1).
PARAMETER_PARTS = (
    "direct", "process", "output", "elec_emissions", "elec_output", "crude_direct", "crude_process",
)

#: Fixed regional fuel mix behind scope 3.
LIQUIDS_REGION = "USA"


def _parameters(
    catalog: Mapping[str, DataFrame], attr: str, sectors: Mapping[str, str], region: Value,
    horizon: int, meta: ModelMetadata,
) -> DataFrame:
    """Rows of one emission parameter for several parts (part -> sector), from one scan."""
    rows = grt_rows(catalog, attr, list(dict.fromkeys(sectors.values())), region, horizon, meta=meta)
    return parts_of(rows, [(part, F.col("G") == sector) for part, sector in sectors.items()])


def _scope2_parts(
    catalog: Mapping[str, DataFrame], sector: str, region: Value, horizon: int,
    meta: ModelMetadata, carrier: str,
) -> dict[str, DataFrame]:
    """Output of electricity and its use by a sector. Its emissions come with the other sectors'."""
    use = filter_dims(until(catalog["ei_t"], horizon), e=carrier, G=sector, R=region)
    return {
        "elec_output": grt_rows(catalog, "agy", meta.electricity, region, horizon, meta=meta),
        "elec_use": use,
    }


def _aligned(
    catalog: Mapping[str, DataFrame],
    parts: Mapping[str, DataFrame],
    emitted: Mapping[str, Mapping[str, str]],
    region: Value,
    horizon: int,
    meta: ModelMetadata,
) -> DataFrame:
    """All parts by scenario and year. For one region, duplicate parameter rows are averaged.

    ``emitted`` lists, per emission symbol, the parts it gives and their sectors.
    """
    shared = {
        tuple(sectors): _parameters(catalog, attr, sectors, region, horizon, meta)
        for attr, sectors in emitted.items()
        if sectors
    }
    names = [*parts, *chain.from_iterable(shared)]
    averaged = [] if is_open(region) else [name for name in names if name in PARAMETER_PARTS]
    return side_by_side(parts, averaged=averaged, shared=shared)


def _scope2() -> Column:
    return product(safe_div("elec_emissions", "elec_output"), "elec_use")


def scope2(
    catalog: Mapping[str, DataFrame],
    sector: str,
    region: Value = "global",
    horizon: int = 2100,
    *,
    carrier: str | None = None,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-3: emissions of the electricity a sector uses, as intensity of supply times use."""
    parts = _scope2_parts(catalog, sector, region, horizon, meta, carrier or meta.electricity)
    emitted = {"sco2": {"elec_emissions": meta.electricity}}
    return (
        _aligned(catalog, parts, emitted, region, horizon, meta)
        .filter(F.col("elec_emissions").isNotNull())
        .select(SCENARIO, TIME, _scope2().alias(VALUE))
    )


def non_co2(
    catalog: Mapping[str, DataFrame],
    sector: str,
    region: Value = "global",
    horizon: int = 2100,
    *,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """Rows of a sector's other greenhouse gases in CO2 equivalents."""
    gases = filter_dims(until(catalog["ghgky"], horizon), G=sector, R=region)
    return gases.withColumn(VALUE, product(VALUE, lookup("GHG", meta.gwp)) / 1000.0)


def energy_factor(
    catalog: Mapping[str, DataFrame], sector: str, region: Value = "global"
) -> DataFrame:
    """Energy per output value of a sector, per scenario; the mean over regions when global."""
    factors = filter_dims(eq(catalog["ejoe"], "G", sector), R=region).select(SCENARIO, "R", VALUE)
    return factor_mean(first_by(factors, [SCENARIO, "R"], VALUE), [SCENARIO])


def sector_intensity(
    df: DataFrame,
    emissions: Mapping[str, Column],
    catalog: Mapping[str, DataFrame],
    sector: str,
    region: Value = "global",
    *,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-4: emissions per unit of output, for each named emission column.

    ``df`` carries ``output`` and, for electricity, ``generation``. Electricity is per total
    generation, tonnage sectors per tonne, everything else per unit of energy: output times the
    sector's energy factor. For one region a missing factor counts as 1.
    """
    if sector == meta.electricity:
        ratio = lambda e: safe_div(e, F.col("generation")) * 1000.0
    elif sector in meta.mass_sectors:
        ratio = lambda e: safe_div(e, F.col("output")) * 1000.0
    else:
        factors = energy_factor(catalog, sector, region)
        df = df.join(factors.withColumnRenamed(VALUE, "factor"), SCENARIO, "left")
        factor = F.col("factor") if is_open(region) else F.coalesce("factor", F.lit(1.0))
        ratio = lambda e: safe_div(e, F.col("output") * factor)
    kept = [c for c in df.columns if c not in ("factor", *emissions)]
    return df.select(*kept, *[ratio(e).alias(name) for name, e in emissions.items()])


def liquids_emission_factor(
    catalog: Mapping[str, DataFrame], region: Value = LIQUIDS_REGION, *,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """Emissions per unit of liquid fuel burnt, from the fuel mix of a region.

    The sum of share times factor is the factor-weighted sum over the total, in one aggregate.
    """
    fuels = liquids_mix(catalog, region, meta=meta)
    burnt = F.sum(product(VALUE, lookup("Technology", meta.emission_factors)))
    return fuels.groupBy(SCENARIO, F.col(YEAR).alias(TIME)).agg(
        safe_div(burnt, F.sum(VALUE)).alias(VALUE)
    )


def intensity(
    catalog: Mapping[str, DataFrame],
    sector: str,
    region: Value = "global",
    horizon: int = 2100,
    *,
    reporting: DataFrame | None = None,
    with_scope2: bool = False,
    with_scope3: bool = False,
    ghg: bool = False,
    process: bool = True,
    carrier: str | None = None,
    liquids_region: Value = LIQUIDS_REGION,
    any_sector: bool = False,
    last_year: int = 2100,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-5..N-8: emission intensity by scenario and year, one column per scope asked for.

    Columns are ``scope1`` and, when asked for, ``scope12`` and ``scope123``. Process and non-CO2
    emissions count as 0 where absent; a missing scope 2 or 3 addition makes that scope NULL.
    Electricity needs the ``reporting`` table for total generation. Scope 3 is the burning of the
    sold liquid fuel: other sectors than refining are refused unless ``any_sector``. Years past
    ``last_year`` are no part of an intensity, whatever the horizon.
    """
    if with_scope3 and sector != meta.refined_oil and not any_sector:
        raise ValueError("scope 3 is defined for refined oil; pass any_sector=True to force it")
    last = min(horizon, last_year)
    parts = {"output": grt_rows(catalog, "agy_bt", sector, region, last, meta=meta)}
    direct, process_co2 = {"direct": sector}, {}
    scope1 = F.col("direct")
    if process and sector in meta.process_sectors:
        process_co2["process"] = sector
        scope1 = scope1 + zero_if_null("process")
    if ghg:
        parts["non_co2"] = non_co2(catalog, sector, region, last, meta=meta)
        scope1 = scope1 + zero_if_null("non_co2")
    emissions = {"scope1": scope1}

    if with_scope2:
        parts.update(
            _scope2_parts(catalog, sector, region, last, meta, carrier or meta.electricity)
        )
        direct["elec_emissions"] = meta.electricity
        scope12 = scope1 + _scope2()
        if sector == meta.refined_oil:
            direct["crude_direct"] = process_co2["crude_process"] = meta.crude_oil
            scope12 = scope12 + F.col("crude_direct") + F.col("crude_process")
        emissions["scope12"] = scope12

    if sector == meta.electricity:
        if reporting is None:
            raise ValueError("the intensity of electricity needs the reporting table")
        total = eq(until(reporting, last, YEAR), "Attribute", meta.total_electricity_attribute)
        parts["generation"] = filter_dims(total, Region=region).withColumnRenamed(YEAR, TIME)

    if with_scope3:
        parts["burning"] = liquids_emission_factor(catalog, liquids_region, meta=meta)

    emitted = {"sco2": direct, "etotco2": process_co2}
    aligned = _aligned(catalog, parts, emitted, region, last, meta).filter(F.col("output").isNotNull())
    df = sector_intensity(aligned, emissions, catalog, sector, region, meta=meta)
    if with_scope3:
        base = "scope12" if with_scope2 else "scope1"
        df = df.withColumn("scope123", F.col(base) + F.col("burning"))
    scopes = [c for c in ("scope1", "scope12", "scope123") if c in df.columns]
    return df.select(SCENARIO, TIME, *scopes)


def scope_bands(df: DataFrame) -> DataFrame:
    """N-9: the band each wider scope adds, where it adds something.

    Takes the frame of ``intensity``; gives (Scenario, t, band, lower, upper).
    """
    scopes = [c for c in ("scope1", "scope12", "scope123") if c in df.columns]
    bands = [
        F.struct(F.lit(upper).alias("band"), F.col(lower).alias("lower"), F.col(upper).alias("upper"))
        for lower, upper in zip(scopes, scopes[1:])
    ]
    if not bands:
        raise ValueError("bands need at least two scopes")
    return df.select(SCENARIO, TIME, F.inline(F.array(*bands))).filter(
        F.col("upper") > F.col("lower")
    )

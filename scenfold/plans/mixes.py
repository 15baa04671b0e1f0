"""Technology mixes (N-29..N-33).

Every mix reads its symbol once: rows are selected by an ``IN`` on the source labels, relabelled
and summed in one aggregate, instead of one scan per technology.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenfold.functions.fit import CARRIERS, TECHNOLOGIES, constrained_mix
from scenfold.functions.scalars import lookup, product, safe_div
from scenfold.metadata import ETHANOL_BLEND, TRANSPORT_SPLIT, DEFAULT, ModelMetadata
from scenfold.model import SCENARIO, TIME, VALUE, YEAR
from scenfold.operators.aggregates import agg_mean, agg_sum
from scenfold.operators.compare import row_share
from scenfold.operators.filters import (
    Value, eq, filter_dims, horizon as until, isin, one_or_many,
)
from scenfold.operators.joins import convert, parts_of, side_by_side
from scenfold.operators.projections import relabel, split
from scenfold.operators.reshape import widened
from scenfold.plans.parameters import grt_rows, is_averaged

#: Optional steel symbols and the technology they report.
STEEL_CCS_SYMBOLS = {"ish2t_out": "DRI-H2 CCS", "isgcapt_out": "DRI-EAF CCS"}


def technology_mix(
    df: DataFrame,
    techs: Mapping[str, str],
    factors: Mapping[str, float] | None,
    region: Value = "global",
    *,
    strict: bool = False,
    wide: bool = False,
) -> DataFrame:
    """Rows of the given technologies, converted by region and summed by their new label.

    ``wide`` gives one column per label.
    """
    df = isin(filter_dims(df, R=region), "tech", list(techs))
    df = relabel(df, "tech", techs)
    if factors is not None:
        df = convert(df, factors, strict=strict)
    df = df.select(
        SCENARIO, F.col(TIME).alias(YEAR), F.col("tech").alias("Technology"), VALUE
    )
    mix = agg_sum(df, [SCENARIO, YEAR, "Technology"])
    return widened(mix, wide, "Technology", list(dict.fromkeys(techs.values())))


def cement_mix(
    catalog: Mapping[str, DataFrame], region: Value = "global", *,
    symbol: str = "nmm_out", strict: bool = False, wide: bool = False, meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-30: cement in Mt with and without capture."""
    factors = meta.conversion[meta.cement]
    return technology_mix(
        catalog[symbol], meta.cement_techs, factors, region, strict=strict, wide=wide
    )


def clinker_mix(
    catalog: Mapping[str, DataFrame], region: Value = "global", *,
    symbol: str = "nmm_out", strict: bool = False, wide: bool = False, meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-33: clinker, fly ash and steel slags in Mt."""
    factors = meta.conversion[meta.cement]
    return technology_mix(
        catalog[symbol], meta.clinker_techs, factors, region, strict=strict, wide=wide
    )


def fuel_shares(
    catalog: Mapping[str, DataFrame], region: Value = "global", *, meta: ModelMetadata = DEFAULT
) -> DataFrame:
    """N-31: share of each liquid fuel in refined-oil use, as (Scenario, t, fuel, share).

    Sectors map to their main fuel; transport fuel is then split over gasoline, diesel and
    kerosene.
    """
    use = filter_dims(eq(catalog["e_aai"], "e", meta.refined_oil), R=region)
    use = isin(use, "G", list(meta.sector_fuels)).select(
        SCENARIO, TIME, lookup("G", meta.sector_fuels).alias("fuel"), F.col(VALUE).alias("share")
    )
    keys = [SCENARIO, TIME, "fuel"]
    shares = row_share(agg_sum(use, keys, "share"), 1.0, value="share")
    return agg_sum(split(shares, "fuel", TRANSPORT_SPLIT, "share"), keys, "share")


def liquids_mix(
    catalog: Mapping[str, DataFrame],
    region: Value = "global",
    *,
    biofuel_agg: str = "sum",
    wide: bool = False,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-32: liquids by fuel: fossil liquids over N-31 shares, plus both biofuel generations.

    ``biofuel_agg='mean'`` averages the two generations instead of adding them. ``wide`` gives one
    column per fuel.
    """
    rows = isin(filter_dims(catalog["liquids"], R=region), "tech", list(meta.liquid_techs))
    liquids = agg_sum(rows, [SCENARIO, TIME, "tech"])
    kind = lookup("tech", meta.liquid_techs)

    # Fossil rows fan out over the fuels, biofuel rows match nothing and pass through.
    shares = fuel_shares(catalog, region, meta=meta).withColumnsRenamed(
        {SCENARIO: "__scenario", TIME: "__time"}
    )
    joined = liquids.withColumn("kind", kind).join(
        shares,
        (F.col("kind") == "Fossil")
        & (F.col(SCENARIO) == F.col("__scenario"))
        & (F.col(TIME) == F.col("__time")),
        "left",
    )
    fossil = F.col("kind") == "Fossil"
    fuels = joined.select(
        SCENARIO,
        TIME,
        F.when(fossil, F.col("fuel")).otherwise(F.col("kind")).alias("Technology"),
        F.when(fossil, product(VALUE, "share")).otherwise(F.col(VALUE)).alias(VALUE),
    ).filter(F.col("Technology").isNotNull())
    if one_or_many(region) == meta.ethanol_region:
        fuels = split(fuels, "Technology", ETHANOL_BLEND)
    combine = agg_mean if biofuel_agg == "mean" else agg_sum
    fuels = fuels.withColumnRenamed(TIME, YEAR)
    fuels = combine(fuels, [SCENARIO, YEAR, "Technology"])
    return widened(fuels, wide, "Technology")


def _steel_frame(
    catalog: Mapping[str, DataFrame], region: Value, horizon: int,
    extra: Mapping[str, DataFrame], meta: ModelMetadata,
) -> DataFrame:
    """Steel output and carrier energy side by side, from one aggregate and one energy scan."""
    output = grt_rows(catalog, "agy", meta.steel, region, horizon, meta=meta)
    energy = filter_dims(
        until(catalog["ee_sect"], horizon), G=meta.steel, R=region, e=list(meta.steel_carriers)
    )
    carrier = lookup("e", meta.steel_carriers)
    carriers = parts_of(energy, [(name, carrier == name) for name in CARRIERS])
    averaged = ["output"] if is_averaged("agy", region, meta=meta) else []
    return side_by_side(
        {"output": output, **extra}, averaged=averaged, shared={CARRIERS: carriers}
    )


def _with_intensity(df: DataFrame) -> DataFrame:
    per_tonne = {c: safe_div(F.col(c), F.col("output") / 1000.0) for c in CARRIERS}
    return df.withColumns({f"i_{c}": column for c, column in per_tonne.items()})


def steel_intensity(
    catalog: Mapping[str, DataFrame], region: Value = "global", horizon: int = 2100, *,
    meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-29: energy per tonne of steel by carrier, refined oil counted with coal."""
    df = _with_intensity(_steel_frame(catalog, region, horizon, {}, meta))
    observed = F.coalesce(*[F.col(c) for c in CARRIERS]).isNotNull()
    return df.filter(observed).select(
        SCENARIO, F.col(TIME).alias(YEAR), *[F.col(f"i_{c}").alias(c) for c in CARRIERS]
    )


def steel_mix(
    catalog: Mapping[str, DataFrame], region: Value = "global", horizon: int = 2100, *,
    strict: bool = False, wide: bool = False, meta: ModelMetadata = DEFAULT,
) -> DataFrame:
    """N-29: steel in Mt by technology; ``wide`` gives one column per technology.

    Conventional output is divided by the fitted shares; capture technologies are added where
    their symbols exist. Globally, energy and output are summed over regions before the fit.
    """
    factors = meta.conversion[meta.steel]
    ccs = {
        tech: convert(
            filter_dims(until(catalog[symbol], horizon), R=region), factors, strict=strict
        ).select(SCENARIO, TIME, VALUE)
        for symbol, tech in STEEL_CCS_SYMBOLS.items()
        if symbol in catalog
    }
    df = _with_intensity(_steel_frame(catalog, region, horizon, ccs, meta))
    df = constrained_mix(df, [f"i_{c}" for c in CARRIERS])
    observed = F.coalesce(*[F.col(c) for c in CARRIERS]).isNotNull()
    cell = lambda tech, value, exists: F.struct(
        F.lit(tech).alias("Technology"), value.alias(VALUE), exists.alias("exists")
    )
    cells = [
        cell(tech, product(f"fit.x{i}", "output"), observed)
        for i, tech in enumerate(TECHNOLOGIES, start=1)
    ] + [cell(tech, F.col(f"`{tech}`"), F.col(f"`{tech}`").isNotNull()) for tech in ccs]
    mix = (
        df.select(SCENARIO, F.col(TIME).alias(YEAR), F.inline(F.array(*cells)))
        .filter("exists")
        .drop("exists")
    )
    return widened(mix, wide, "Technology", [*TECHNOLOGIES, *ccs])


__all__ = [
    "cement_mix", "clinker_mix", "fuel_shares", "liquids_mix", "steel_intensity", "steel_mix",
    "technology_mix",
]

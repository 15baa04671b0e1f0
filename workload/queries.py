
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenfold.functions.fit import constrained_mix
from scenfold.functions.scalars import ej_to_twh, key, label, lookup, product, safe_div, scale
from scenfold.metadata import TRANSPORT_SPLIT, metadata
from scenfold.model import SCENARIO, TIME, VALUE, YEAR
from scenfold.operators import (
    aggregates, charts, compare, filters, joins, ordering, projections, reshape,
)
from scenfold.plans import (
    balance, energy, inputs, intensity, mixes, parameters, reporting, trade,
)
from scenfold.sources import symbols as sources
from scenfold.sources.registry import scenario_registry
from scenfold.sources.star import (
    REFERENCE_SCENARIO as REF,
    SCENARIOS,
    amount,
    facts,
    shared_catalog,
    star_catalog,
    star_symbol,
    table,
)
from scenfold.sources.sinks import read_csv, write_csv
from scenfold.sources.storage import checkpoint_dir, cut
from workload.settings import ELECTRICITY_CARRIER, ENERGY_META, HORIZON, META, YEARS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SECTORS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
KEYS = [SCENARIO, TIME]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Doubles at comparison precision: engines sum them in different orders.

    The digits are chosen per query so that no exact result sits halfway between two roundings.
    """
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols or (VALUE,)})


def rows(df: DataFrame, *dims: str, digits: int = 2) -> DataFrame:
    return rounded(df.select(SCENARIO, *dims, VALUE), digits)


def _in(region: str) -> dict:
    """For a shared catalog: one region is all that an analysis reads."""
    return {"where": F.col("R") == region, "where_dims": ["R"]}


# --- Sources ---------------------------------------------------------------


@query
def src_registry(spark, sf_dir):
    entries = {
        "1-URGENT": {"path": "runs/urgent", "case": "ref"},
        "2-HIGH": {"gdx": "runs/high", "case": "high"},
        "3-MEDIUM": "runs/medium",
        "9-NONE": None,
    }
    registry = scenario_registry(spark, entries)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario"))
    counts = orders.agg(F.count("*").alias("n_orders"))
    return registry.join(counts, "scenario", "left")


@query
def src_load(spark, sf_dir):
    entries = {
        "base": sf_dir,
        "alt": {"path": sf_dir, "case": "high"},
        "gone": f"{sf_dir}/no_such_run",
    }
    catalog = sources.load_scenarios(spark, entries, symbols=["orders", "supplier"])
    orders = catalog["orders"].groupBy("Scenario", "Case", F.col("o_orderstatus").alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias(VALUE)
    )
    suppliers = catalog["supplier"].groupBy("Scenario", "Case", label("s_nationkey").alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias(VALUE)
    )
    return joins.union_all(orders, suppliers)


@query
def src_stamp(spark, sf_dir):
    stamped = sources.stamp(table(spark, sf_dir, "orders"), "base", "ref")
    return stamped.groupBy("Scenario", "Case", "o_orderpriority").agg(F.count("*").alias("n"))


@query
def src_case(spark, sf_dir):
    """Written by scenario, reopened, and chosen by the registry's case: other folders stay closed."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/symbols-{uuid.uuid4().hex}"
    entries = {s: {"path": path, "case": "high" if s < "3" else "low"} for s in SCENARIOS}
    saved = {"agy": star_symbol(spark, sf_dir, "agy").drop("Case")}
    sources.save_symbols(saved, path, registry=scenario_registry(spark, entries))
    opened = sources.open_symbols(spark, path)["agy"]
    high = sources.of_case(opened, sources.open_registry(spark, path), "high")
    return rounded(aggregates.agg_sum(high, [SCENARIO, "Case", TIME]), 2)


def _runs(spark, sf_dir, **tables):
    """Two scenario folders that hold the named frames: (first, second), None for no dataset."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    for name, frames in tables.items():
        for run, df in zip(("a", "b"), frames, strict=True):
            if df is not None:
                df.write.parquet(f"{path}/{run}/{name}")
    return {"a": f"{path}/a", "b": {"path": f"{path}/b", "case": "b"}}


@query
def src_drop_empty(spark, sf_dir):
    """A part that is emptied, one of nulls alone, and whole ones; what is left of every symbol."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice")
    nation = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    blank = nation.select(F.lit(None).cast("string").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"))
    runs = _runs(spark, sf_dir, orders=(orders, orders.filter("o_totalprice < 0")), nation=(blank, nation))
    catalog = sources.load_scenarios(spark, runs)
    counts = [
        df.groupBy(SCENARIO).agg(F.count("*").alias("n")).withColumn("symbol", F.lit(name))
        for name, df in catalog.items()
    ]
    return joins.union_all(*counts)


def _gates(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer")
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return _runs(
        spark, sf_dir, nation=(nation, nation), region=(region, region.withColumn("r_extra", F.lit(1))),
        customer=(customer, customer.select(*reversed(customer.columns))), orders=(keys, keys), supplier=(None, keys),
    )


def _gated(spark, sf_dir, names):
    """What the gates say of each symbol, with the rows that were loaded of it."""
    runs = _gates(spark, sf_dir)
    catalog = sources.load_scenarios(spark, runs, symbols=names)
    counts = [df.agg(F.count("*").alias("n")).withColumn("symbol", F.lit(s)) for s, df in catalog.items()]
    both = joins.union_all(sources.gate_report(spark, runs, names), *counts)
    return both.groupBy("symbol").agg(*[F.max(c).alias(c) for c in ("accepted", "reason", "n")])


@query
def src_schema_gate(spark, sf_dir):
    return _gated(spark, sf_dir, ["nation", "region", "customer"])


@query
def src_min_columns(spark, sf_dir):
    return _gated(spark, sf_dir, ["nation", "orders", "supplier"])


@query
def src_rename(spark, sf_dir):
    raw = facts(spark, sf_dir, ["t", "G", "R", "qty"])
    raw = raw.groupBy("t", "G", "R").agg(amount("qty").alias("level"))
    return sources.rename_symbol("sco2", raw.toDF("d1", "d2", "d3", "level"))


@query
def src_time_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    year = label(F.year("o_orderdate"))
    labelled = orders.select(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(year).alias("t")
    )
    kept = filters.time_range(labelled, "t", 1997, 1999)
    return kept.groupBy(F.col("o_orderpriority").alias(SCENARIO), "t").agg(F.count("*").alias("n"))


@query
def src_reporting(spark, sf_dir):
    data = sources.reporting_table(star_catalog(spark, sf_dir), (1996, HORIZON))
    return rows(data, "Attribute", YEAR, "Region")


@query
def meta_join(spark, sf_dir):
    totals = aggregates.agg_sum(star_symbol(spark, sf_dir, "agy"), ["G", "R"])
    conversion = F.broadcast(metadata(spark, "conversion", META))
    return rounded(totals.join(conversion, ["G", "R"], "left"), 2)


# --- Filters and projections -----------------------------------------------


@query
def fil_eq(spark, sf_dir):
    return rows(filters.eq(star_symbol(spark, sf_dir, "sco2"), "G", "PROMO"), "G", "R", "t")


@query
def fil_isin(spark, sf_dir):
    wanted = ["Brand#3", "Brand#7", "Brand#11", "Brand#99"]
    df = filters.isin(star_symbol(spark, sf_dir, "AAI"), "ne", wanted)
    return rows(aggregates.agg_sum(df, [SCENARIO, "ne", "t"]), "ne", "t")


@query
def fil_semi(spark, sf_dir):
    """Sectors' inputs among the brands of a table: those whose parts are larger than most."""
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("size"))
    df = filters.isin(star_symbol(spark, sf_dir, "AAI"), "ne", parts.filter("size > 25").select("p_brand"))
    return rounded(aggregates.agg_sum(df, [SCENARIO, "ne", "t"]), 2)


@query
def fil_horizon(spark, sf_dir):
    return rows(filters.horizon(star_symbol(spark, sf_dir, "agy"), HORIZON), "G", "R", "t")


@query
def fil_wildcard(spark, sf_dir):
    df = filters.filter_dims(star_symbol(spark, sf_dir, "agy"), G="PROMO", R="global")
    return rows(df, "G", "R", "t")


@query
def fil_dims(spark, sf_dir):
    df = filters.filter_dims(star_symbol(spark, sf_dir, "ee_sect"), G="PROMO", R="ASIA", e="all")
    return rows(df, "G", "R", "e", "t")


@query
def fil_region_list(spark, sf_dir):
    df = filters.region(star_symbol(spark, sf_dir, "data"), ["ASIA", "EUROPE"], "Region")
    return rows(df, "Attribute", YEAR, "Region")


@query
def prj_drop(spark, sf_dir):
    df = filters.eq(star_symbol(spark, sf_dir, "ei_t"), "e", "A")
    return rounded(projections.drop(df, "e", "Case"), 2)


@query
def prj_relabel(spark, sf_dir):
    df = projections.relabel(star_symbol(spark, sf_dir, "agy"), "R", META.region_names)
    return rows(aggregates.agg_sum(df, [SCENARIO, "R", "t"]), "R", "t")


@query
def prj_order(spark, sf_dir):
    df = reshape.pivot_sum(star_symbol(spark, sf_dir, "agy"), KEYS, "G", ["SMALL", "LARGE"])
    return rounded(projections.order(df, KEYS, ["LARGE", "NONE", "SMALL"]), 2, "LARGE", "SMALL")


# --- Scalars ----------------------------------------------------------------


@query
def sca_units(spark, sf_dir):
    df = aggregates.agg_sum(star_symbol(spark, sf_dir, "agy"), KEYS)
    return df.select(
        *KEYS,
        F.round(scale(VALUE, 1 / 1000), 5).alias("thousands"),
        F.round(scale(VALUE, 10), 1).alias("tens"),
        F.round(ej_to_twh(VALUE), 0).alias("twh"),
    )


@query
def sca_try_divide(spark, sf_dir):
    df = aggregates.agg_sum(star_symbol(spark, sf_dir, "agy"), [SCENARIO, "G", "t"])
    divisor = F.when(F.col("G") == "SMALL", 0.0).otherwise(F.col("t") - 1990.0)
    return df.select(SCENARIO, "G", "t", F.round(safe_div(F.col(VALUE), divisor), 5).alias(VALUE))


@query
def sca_map(spark, sf_dir):
    weights = {k: v for k, v in META.gwp.items() if k != "MACHINERY"}
    df = aggregates.agg_sum(star_symbol(spark, sf_dir, "ghgky"), [SCENARIO, "GHG", "t"])
    return df.select(
        SCENARIO, "GHG", "t", F.round(product(VALUE, lookup("GHG", weights)), 1).alias(VALUE)
    )


@query
def sca_key(spark, sf_dir):
    df = aggregates.agg_sum(star_symbol(spark, sf_dir, "sco2"), KEYS)
    return df.select(key(SCENARIO, "t").alias("bar"), F.round(VALUE, 2).alias(VALUE))


@query
def sca_split(spark, sf_dir):
    use = star_symbol(spark, sf_dir, "e_aai")
    fuels = use.select(SCENARIO, "t", lookup("G", META.sector_fuels).alias("fuel"), VALUE)
    parts = projections.split(aggregates.agg_sum(fuels, [*KEYS, "fuel"]), "fuel", TRANSPORT_SPLIT)
    return rows(aggregates.agg_sum(parts, [*KEYS, "fuel"]), "t", "fuel", digits=4)


@query
def sca_product(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, ["agy", "DPD"])
    both = joins.side_by_side({"a": catalog["agy"], "b": catalog["DPD"]}, [*KEYS, "G", "R"])
    return both.select(*KEYS, "G", "R", F.round(product("a", "b"), 8).alias(VALUE))


# --- Joins -------------------------------------------------------------------


@query
def join_left(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, ["agy", "etotco2"])
    output = aggregates.agg_sum(catalog["agy"], KEYS)
    late = filters.horizon(catalog["etotco2"], 1998)
    emissions = aggregates.agg_sum(late, KEYS).withColumnRenamed(VALUE, "Emissions")
    return rounded(joins.left_on(output, emissions), 2, VALUE, "Emissions")


@query
def join_conv(spark, sf_dir):
    df = filters.eq(star_symbol(spark, sf_dir, "agy"), "G", "PROMO")
    return rows(joins.convert(df, META.conversion["PROMO"]), "R", "t", digits=3)


@query
def join_conv_report(spark, sf_dir):
    """Rows without a conversion factor, by region; the same number is observed while converting."""
    df = filters.eq(star_symbol(spark, sf_dir, "agy"), "G", "PROMO")
    return joins.unmatched_rows(df, META.conversion["PROMO"], [SCENARIO])


@query
def join_factor(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, ["agy", "ejoe"])
    factors = catalog["ejoe"].select(SCENARIO, "R", "G", VALUE)
    df = joins.with_factor(catalog["agy"], factors, [SCENARIO, "R", "G"], default=1.0)
    df = df.withColumn(VALUE, product(VALUE, "factor"))
    return rounded(df.select(SCENARIO, "R", "G", "t", "factor", VALUE), 8, "factor", VALUE)


@query
def lim_first(spark, sf_dir):
    """Several factors per key: the least counts, and no row is multiplied."""
    catalog = shared_catalog(spark, sf_dir, ["agy", "ejoe"])
    df = joins.with_factor(catalog["agy"], catalog["ejoe"], [SCENARIO, "R"])
    return rounded(df.select(SCENARIO, "R", "G", "t", "factor", VALUE), 6, "factor", VALUE)


@query
def join_align(spark, sf_dir):
    promo = {"where": F.col("G") == "PROMO", "where_dims": ["G"]}
    catalog = shared_catalog(spark, sf_dir, ["sco2", "etotco2"], **promo)
    keys = [*KEYS, "R"]
    a = filters.eq(catalog["sco2"], "G", "PROMO")
    b = filters.horizon(filters.eq(catalog["etotco2"], "G", "PROMO"), 1999)
    summed = joins.align(a, b, "+", keys).withColumnRenamed(VALUE, "added")
    ratio = joins.align(b, a, "/", keys).withColumnRenamed(VALUE, "ratio")
    return rounded(joins.left_on(summed, ratio, keys), 6, "added", "ratio")


# --- Aggregations and reshape --------------------------------------------------


@query
def agg_sum(spark, sf_dir):
    return rows(aggregates.agg_sum(star_symbol(spark, sf_dir, "agy"), KEYS), "t")


@query
def agg_mean(spark, sf_dir):
    return rows(aggregates.agg_mean(star_symbol(spark, sf_dir, "DPD"), KEYS), "t", digits=9)


@query
def agg_by_type(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, ["DPD", "agy"])
    price = aggregates.agg_by_type(catalog["DPD"], KEYS, META.parameter_type("DPD"))
    output = aggregates.agg_by_type(catalog["agy"], KEYS, META.parameter_type("agy"))
    both = joins.side_by_side({"price": price, "output": output})
    return rounded(both, 9, "price").withColumn("output", F.round("output", 2))


@query
def agg_factor_mean(spark, sf_dir):
    df = aggregates.factor_mean(star_symbol(spark, sf_dir, "ejoe"), [SCENARIO, "G"])
    return rows(df, "G", digits=9)


@query
def agg_ndistinct(spark, sf_dir):
    df = facts(spark, sf_dir, [SCENARIO, "t", "R", "G", "ne"])
    return aggregates.distinct_count(df, SCENARIO, "t", "R", "G", "ne")


@query
def agg_dynamic(spark, sf_dir):
    dims = {"R": "ASIA", "G": "all", "e": "all"}
    df = filters.filter_dims(star_symbol(spark, sf_dir, "ee_sect"), **dims)
    return rows(aggregates.agg_open_dims(df, dims), "t", "G", "e")


@query
def pivot_sum(spark, sf_dir):
    df = reshape.pivot_sum(star_symbol(spark, sf_dir, "agy"), KEYS, "G", SECTORS)
    return rounded(df, 2, *SECTORS)


@query
def pivot_mean(spark, sf_dir):
    df = reshape.pivot_mean(star_symbol(spark, sf_dir, "DPD"), [TIME], SCENARIO, SCENARIOS)
    return rounded(df, 9, *SCENARIOS)


@query
def pivot_auto(spark, sf_dir):
    df = filters.filter_dims(star_symbol(spark, sf_dir, "ee_sect"), G="PROMO", e="A")
    df = aggregates.agg_sum(df, [*KEYS, "e", "G", "R"])
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return rounded(reshape.pivot_auto(df, KEYS, values=regions), 2, *regions)


@query
def unpivot(spark, sf_dir):
    wide = reshape.pivot_sum(star_symbol(spark, sf_dir, "agy"), KEYS, "G", ["LARGE", "SMALL", "NONE"])
    return rows(reshape.melt(wide, KEYS, ["LARGE", "SMALL", "NONE"], "G"), "t", "G")


# --- Comparison ------------------------------------------------------------------


def _output(spark, sf_dir):
    return parameters.grt(star_catalog(spark, sf_dir), "agy", "LARGE", meta=META)


@query
def cmp_index(spark, sf_dir):
    return rows(compare.rebase(cut(_output(spark, sf_dir))), "t", digits=6)


@query
def cmp_index_years(spark, sf_dir):
    return rows(parameters.compare(_output(spark, sf_dir), years=YEARS, index=True), "t", digits=6)


@query
def cmp_reldiff(spark, sf_dir):
    return rows(compare.reldiff(cut(_output(spark, sf_dir)), REF), "t", digits=6)


@query
def cmp_index_reldiff(spark, sf_dir):
    df = parameters.compare(_output(spark, sf_dir), index=True, relative=True, ref=REF)
    return rows(df, "t", digits=6)


@query
def cmp_share(spark, sf_dir):
    df = aggregates.agg_sum(star_symbol(spark, sf_dir, "agy"), [*KEYS, "G"])
    return rows(compare.row_share(df), "t", "G", digits=6)


@query
def cmp_scendiff(spark, sf_dir):
    df = filters.eq(star_symbol(spark, sf_dir, "data"), "Attribute", "LARGE")
    df = compare.scenario_diff(df, ["2-HIGH", REF])
    return rounded(df, 2)


@query
def srt_keys(spark, sf_dir):
    registry = scenario_registry(spark, dict.fromkeys(reversed(SCENARIOS)))
    df = aggregates.agg_sum(star_symbol(spark, sf_dir, "sco2"), KEYS)
    return rows(ordering.by_registry(df, registry, ranks=True), "t", "ord", "position")


@query
def srt_sink(spark, sf_dir):
    """All cells with their place in the order of scenario, year and sector."""
    cells = aggregates.agg_sum(star_symbol(spark, sf_dir, "agy"), [*KEYS, "G"])
    return rounded(ordering.sorted_by(cells, *KEYS, "G", position="position"), 2)


@query
def srt_total_desc(spark, sf_dir):
    """The three largest sectors."""
    return rounded(ordering.by_total_desc(star_symbol(spark, sf_dir, "agy"), "G").limit(3), 2)


@query
def set_union_all(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, ["sco2", "ei_t"])
    a = aggregates.agg_sum(catalog["sco2"], [*KEYS, "G"])
    b = aggregates.agg_sum(catalog["ei_t"], [*KEYS, "e"])
    return rounded(joins.union_all(a, b), 2)


@query
def fit_mix(spark, sf_dir):
    base = facts(spark, sf_dir, [SCENARIO, "t", "ne", "e", "price"])
    carrier = lambda e: F.sum(F.when(F.col("e") == e, F.col("price"))).cast("double")
    cells = base.groupBy(SCENARIO, "t", "ne").agg(
        carrier("A").alias("a"), carrier("N").alias("n"), carrier("R").alias("r"),
        F.sum("price").cast("double").alias("all"),
    )
    share = lambda c, k: safe_div(F.col(c), F.col("all")) * float(k)
    observed = cells.select(
        SCENARIO, "t", "ne", share("a", 15).alias("b1"), share("n", 6).alias("b2"),
        share("r", 6).alias("b3"),
    )
    fitted = constrained_mix(observed, ["b1", "b2", "b3"])
    return fitted.select(
        SCENARIO, "t", "ne", *[F.round(f"fit.x{i}", 6).alias(f"x{i}") for i in (1, 2, 3)]
    )


# --- Parameter comparison -----------------------------------------------------------


@query
def grt_global(spark, sf_dir):
    return rows(parameters.grt(star_catalog(spark, sf_dir), "agy", "PROMO", meta=META), "t", digits=3)


@query
def grt_region(spark, sf_dir):
    df = parameters.grt(star_catalog(spark, sf_dir), "agy_bt", "PROMO", "ASIA", HORIZON, meta=META)
    return rows(df, "t", digits=3)


@query
def grt_price(spark, sf_dir):
    return rows(parameters.grt(star_catalog(spark, sf_dir), "DPD", "SMALL", meta=META), "t", digits=9)


@query
def grt_index(spark, sf_dir):
    df = parameters.grt_compare(
        star_catalog(spark, sf_dir), "agy", "PROMO", horizon=HORIZON, index=True, meta=META,
        wide=SCENARIOS,
    )
    return rounded(df, 6, *SCENARIOS)


@query
def grt_reldiff(spark, sf_dir):
    df = parameters.grt_compare(
        star_catalog(spark, sf_dir), "agy", "PROMO", relative=True, ref=REF, meta=META
    )
    return rows(df, "t", digits=6)


# --- Intensity -------------------------------------------------------------------------


def _needed(spark, sf_dir, names, sectors, regions=None, **aliases):
    """One pass over the tables for an analysis of a few sectors."""
    where = F.col("G").isin(*sectors)
    if regions:
        where = where & F.col("R").isin(*regions)
    return shared_catalog(
        spark, sf_dir, names, where=where, where_dims=["G", "R"] if regions else ["G"],
        aliases=aliases or None,
    )


@query
def scope2(spark, sf_dir):
    catalog = _needed(spark, sf_dir, ["sco2", "agy", "ei_t"], ["ECONOMY", "MEDIUM"], ["ASIA"])
    df = intensity.scope2(
        catalog, "MEDIUM", "ASIA", HORIZON, carrier=ELECTRICITY_CARRIER, meta=META
    )
    return rows(df, "t", digits=4)


@query
def ci_elec(spark, sf_dir):
    catalog = _needed(spark, sf_dir, ["sco2", "agy_bt", "data"], ["ECONOMY", "MEDIUM"])
    df = intensity.intensity(catalog, "ECONOMY", reporting=catalog["data"], meta=META)
    return rounded(df, 8, "scope1")


@query
def ci_mass(spark, sf_dir):
    catalog = _needed(spark, sf_dir, ["sco2", "agy_bt"], ["PROMO"])
    df = intensity.intensity(catalog, "PROMO", process=False, meta=META)
    return rounded(df, 8, "scope1")


@query
def ci_energy(spark, sf_dir):
    catalog = _needed(spark, sf_dir, ["sco2", "agy_bt", "ejoe"], ["SMALL"], ["EUROPE"])
    one = intensity.intensity(catalog, "SMALL", "EUROPE", process=False, meta=META)
    return rounded(one, 10, "scope1")


@query
def sci_scope1(spark, sf_dir):
    catalog = _needed(spark, sf_dir, ["sco2", "etotco2", "agy_bt"], ["PROMO"])
    return rounded(intensity.intensity(catalog, "PROMO", horizon=HORIZON, meta=META), 8, "scope1")


@query
def sci_ghg(spark, sf_dir):
    catalog = _needed(spark, sf_dir, ["sco2", "ghgky", "agy_bt", "ejoe"], ["MEDIUM"])
    df = intensity.intensity(catalog, "MEDIUM", ghg=True, meta=META)
    return rounded(df, 8, "scope1")


SCI_SYMBOLS = ["sco2", "etotco2", "agy", "agy_bt", "ei_t", "ejoe"]


@query
def sci_scope2(spark, sf_dir):
    catalog = _needed(spark, sf_dir, SCI_SYMBOLS, ["LARGE", "SMALL", "ECONOMY"])
    df = intensity.intensity(
        catalog, "LARGE", with_scope2=True, carrier=ELECTRICITY_CARRIER, meta=META
    )
    return rounded(df, 8, "scope1", "scope12")


def _all_scopes(spark, sf_dir):
    names = [*SCI_SYMBOLS, "liquids", "e_aai"]
    catalog = _needed(spark, sf_dir, names, SECTORS, ["ASIA", "AMERICA"])
    return intensity.intensity(
        catalog, "LARGE", "ASIA", with_scope2=True, with_scope3=True,
        carrier=ELECTRICITY_CARRIER, liquids_region="AMERICA", meta=META,
    )


@query
def sci_scope3(spark, sf_dir):
    return rounded(_all_scopes(spark, sf_dir), 8, "scope1", "scope12", "scope123")


@query
def sci_band(spark, sf_dir):
    return rounded(intensity.scope_bands(_all_scopes(spark, sf_dir)), 8, "lower", "upper")


# --- Trade ----------------------------------------------------------------------------------


def _trade(spark, sf_dir, flow, **options):
    return trade.trade_by_region(
        star_catalog(spark, sf_dir), "LARGE", "ASIA", flow, meta=META, **options
    )


@query
def trade_imports(spark, sf_dir):
    return rows(_trade(spark, sf_dir, "imports"), YEAR, "Region")


@query
def trade_exports(spark, sf_dir):
    return rows(_trade(spark, sf_dir, "exports", horizon=HORIZON), YEAR, "Region")


@query
def trade_net(spark, sf_dir):
    return rows(_trade(spark, sf_dir, "imports", net=True), YEAR, "Region")


@query
def trade_region_list(spark, sf_dir):
    df = trade.trade_by_region(
        star_catalog(spark, sf_dir), "LARGE", ["ASIA", "EUROPE"], "imports", meta=META
    )
    return rows(df, YEAR, "Region")


@query
def trade_wide(spark, sf_dir):
    names = ["Africa", "America", "Asia", "Europe", "MIDDLE EAST"]
    df = _trade(spark, sf_dir, "imports", wide=True, values=names)
    return rounded(df, 2, *names)


@query
def trade_share(spark, sf_dir):
    return rows(_trade(spark, sf_dir, "imports", percent=True), YEAR, "Region", digits=6)


@query
def trade_scendiff(spark, sf_dir):
    df = _trade(spark, sf_dir, "exports", percent=True, difference=["2-HIGH", REF])
    return rounded(df, 6)


@query
def trade_scenario(spark, sf_dir):
    df = trade.trade_by_scenario(
        star_catalog(spark, sf_dir), "LARGE", "ASIA", "imports", relative=True, ref=REF
    )
    return rows(df, YEAR, digits=6)


@query
def trade_scenario_net(spark, sf_dir):
    df = trade.trade_by_scenario(star_catalog(spark, sf_dir), "LARGE", "ASIA", "exports", net=True)
    return rows(df, YEAR)


@query
def trade_world_index(spark, sf_dir):
    df = trade.trade_by_scenario(
        star_catalog(spark, sf_dir), "LARGE", "ASIA", "imports", world=True, relative=True,
        index=True, ref=REF,
    )
    return rows(df, YEAR, digits=3)


# --- Reporting table ----------------------------------------------------------------------------


def _data(spark, sf_dir, name="data"):
    return star_symbol(spark, sf_dir, name)


@query
def emis(spark, sf_dir):
    df = reporting.emissions(_data(spark, sf_dir), horizon=HORIZON, meta=META)
    return rounded(df, 5, *df.columns[2:])


@query
def pemis_co2(spark, sf_dir):
    return rows(reporting.emission_price(_data(spark, sf_dir), "co2", meta=META), YEAR, digits=3)


@query
def pemis_ghg(spark, sf_dir):
    df = reporting.emission_price(_data(spark, sf_dir), "ghg", HORIZON, meta=META)
    return rows(df, YEAR, digits=3)


@query
def pemis_wide(spark, sf_dir):
    data = _data(spark, sf_dir)
    df = reporting.emission_price(data, "co2", wide=True, values=SCENARIOS, meta=META)
    return rounded(df, 3, *SCENARIOS)


@query
def snk_csv(spark, sf_dir):
    """What is written, read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    prices = reporting.emission_price(_data(spark, sf_dir), "co2", meta=META)
    write_csv(rows(prices, YEAR, digits=3), path)
    return read_csv(spark, path, f"{SCENARIO} string, {YEAR} int, {VALUE} double", verify=True)


@query
def nrj(spark, sf_dir):
    df = reporting.primary_energy(_data(spark, sf_dir, "data_brand"), ["ASIA", "EUROPE"], meta=META)
    return rounded(df, 2, *df.columns[2:])


@query
def elec(spark, sf_dir):
    df = reporting.electricity(_data(spark, sf_dir, "data_brand"), "ASIA", meta=META)
    return rounded(df, 2, *df.columns[2:])


@query
def gdp_scenario(spark, sf_dir):
    df = reporting.gdp(_data(spark, sf_dir), region="EUROPE", meta=META)
    return rows(df, YEAR, digits=5)


@query
def gdp_region(spark, sf_dir):
    df = reporting.gdp(_data(spark, sf_dir), by="region", horizon=HORIZON, meta=META)
    return rows(df, YEAR, "Region", digits=5)


@query
def data_global(spark, sf_dir):
    return rows(reporting.attribute(_data(spark, sf_dir), "MEDIUM"), YEAR)


@query
def data_region(spark, sf_dir):
    df = reporting.attribute(_data(spark, sf_dir), "MEDIUM", "AFRICA")
    df = reporting.scenario_columns(df, SCENARIOS)
    return rounded(df, 2, *SCENARIOS)


# --- Energy balance ---------------------------------------------------------------------------------


@query
def tec_by_energy(spark, sf_dir):
    df = energy.energy_use(star_catalog(spark, sf_dir), "PROMO", "ASIA", "all", meta=ENERGY_META)
    return rows(df, YEAR, "e")


@query
def tec_by_sector(spark, sf_dir):
    meta = ENERGY_META
    catalog = star_catalog(spark, sf_dir)
    df = energy.energy_use(catalog, "all", "ASIA", "R", HORIZON, meta=meta)
    return rows(df, YEAR, "G")


@query
def tec_by_region(spark, sf_dir):
    catalog = star_catalog(spark, sf_dir)
    df = energy.energy_use(catalog, "MEDIUM", "all", "R", primary=True, meta=ENERGY_META)
    return rows(df, YEAR, "R")


@query
def tec_percent(spark, sf_dir):
    catalog = star_catalog(spark, sf_dir)
    df = energy.energy_use(catalog, "MEDIUM", "ASIA", "all", percent=True, meta=ENERGY_META)
    return rows(df, YEAR, "e", digits=6)


CARRIER_SYMBOLS = {"ejoe": "ejoe_e", "expo_t": "expo_e"}


@query
def tec_add(spark, sf_dir):
    catalog = shared_catalog(
        spark, sf_dir, ["ee_sect", "ee_add", "ejoe"], aliases=CARRIER_SYMBOLS, **_in("ASIA")
    )
    df = energy.energy_use(catalog, "all", "ASIA", "N", meta=ENERGY_META)
    return rows(df, YEAR, "G", digits=6)


@query
def tec_carrier_list(spark, sf_dir):
    """A list of one carrier means the same as the carrier: self-use and TWh included."""
    catalog = shared_catalog(
        spark, sf_dir, ["ee_sect", "ee_add", "ejoe"], aliases=CARRIER_SYMBOLS, **_in("ASIA")
    )
    df = energy.energy_use(catalog, "all", ["ASIA"], ["A"], meta=ENERGY_META)
    return rows(df, YEAR, "G", digits=6)


def _labelled(spark, sf_dir, sector):
    named = {"A": "electricity", "N": "refined oil", "R": "oil"}
    sectors = {code: (name, name, "", name, None) for code, name in named.items()}
    meta = replace(ENERGY_META, sectors=sectors, refined_oil="N")
    df = energy.energy_use(star_catalog(spark, sf_dir), sector, "ASIA", "all", labels=True, meta=meta)
    return rows(df, YEAR, "e")


@query
def tec_labels(spark, sf_dir):
    """Carriers by name; refined oil is coke in steel."""
    return _labelled(spark, sf_dir, "PROMO")


@query
def tec_labels_cement(spark, sf_dir):
    """Carriers by name; refined oil is petroleum products in cement."""
    return _labelled(spark, sf_dir, "ECONOMY")


@query
def tec_exports(spark, sf_dir):
    names = ["ee_sect", "ee_add", "ejoe", "expo_t"]
    catalog = shared_catalog(
        spark, sf_dir, names, aliases=CARRIER_SYMBOLS,
        where=(F.col("R") == "ASIA") | (F.col("RR") == "ASIA"), where_dims=["R", "RR"],
    )
    df = energy.energy_use(catalog, "all", "ASIA", "A", exports=True, meta=ENERGY_META)
    return rows(df, YEAR, "G", digits=6)


# --- Inputs, supply and demand ---------------------------------------------------------------------------


@query
def ne_inputs(spark, sf_dir):
    df = inputs.inputs(star_catalog(spark, sf_dir), "PROMO", "Brand#5", "ASIA", HORIZON)
    return rows(df, "t")


@query
def ne_inputs_bd(spark, sf_dir):
    return rows(inputs.inputs_breakdown(star_catalog(spark, sf_dir), "PROMO"), YEAR, "ne")


@query
def sd_1d(spark, sf_dir):
    df = balance.supply_demand(
        star_catalog(spark, sf_dir), "PROMO", "ASIA", comm=["supply"], flow=["output", "imports"]
    )
    return rows(df, YEAR, digits=3)


@query
def sd_1d_reldiff(spark, sf_dir):
    df = balance.supply_demand(
        star_catalog(spark, sf_dir), "PROMO", "ASIA", relative=True, ref=REF, years=YEARS
    )
    return rows(df, YEAR, digits=6)


@query
def sd_2d(spark, sf_dir):
    df = balance.supply_demand_flows(star_catalog(spark, sf_dir), "PROMO", "ASIA", horizon=HORIZON)
    return rounded(df, 3, "output", "imports", "exports", "demand")


# --- Mixes ------------------------------------------------------------------------------------------------


STEEL_SYMBOLS = ["agy", "ee_sect", "ish2t_out", "isgcapt_out"]


@query
def steel_intensity(spark, sf_dir):
    catalog = _needed(spark, sf_dir, ["agy", "ee_sect"], ["PROMO"], ["ASIA"])
    df = mixes.steel_intensity(catalog, "ASIA", meta=META)
    return rounded(df, 8, "COAL", "GAS", "ELEC")


@query
def steel_mix(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, STEEL_SYMBOLS)
    return rows(mixes.steel_mix(catalog, meta=META), YEAR, "Technology", digits=1)


@query
def steel_mix_wide(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, STEEL_SYMBOLS)
    df = mixes.steel_mix(catalog, wide=True, meta=META)
    return rounded(df, 1, *df.columns[2:])


@query
def cement_mix(spark, sf_dir):
    df = mixes.cement_mix(star_catalog(spark, sf_dir), symbol="cement_out", meta=META)
    return rows(df, YEAR, "Technology", digits=3)


@query
def clinker_mix(spark, sf_dir):
    df = mixes.clinker_mix(star_catalog(spark, sf_dir), "ASIA", symbol="clinker_out", meta=META)
    return rows(df, YEAR, "Technology", digits=1)


@query
def fuel_shares(spark, sf_dir):
    df = mixes.fuel_shares(star_catalog(spark, sf_dir), "ASIA", meta=META)
    return rounded(df, 6, "share")


@query
def liquids_mix(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, ["liquids", "e_aai"], **_in("AMERICA"))
    df = mixes.liquids_mix(catalog, "AMERICA", meta=META)
    return rows(df, YEAR, "Technology", digits=2)


@query
def liquids_region_list(spark, sf_dir):
    catalog = shared_catalog(spark, sf_dir, ["liquids", "e_aai"], **_in("AMERICA"))
    df = mixes.liquids_mix(catalog, ["AMERICA"], meta=META)
    return rows(df, YEAR, "Technology", digits=2)


# --- Chart data ---------------------------------------------------------------------------------------------


def _by_sector(spark, sf_dir):
    return star_symbol(spark, sf_dir, "agy").withColumnRenamed(TIME, YEAR)


@query
def cht_stack(spark, sf_dir):
    df = charts.stack_offsets(_by_sector(spark, sf_dir), "G", ["SMALL", "LARGE", "PROMO"])
    return rounded(df, 2, VALUE, "bottom")


@query
def cht_stack_signed(spark, sf_dir):
    flows = _trade(spark, sf_dir, "exports", net=True)
    df = charts.stack_offsets(flows, "Region", ["Europe", "Africa", "America"], signed=True)
    return rounded(df, 2, *df.columns[3:])


@query
def cht_axis_mid(spark, sf_dir):
    bars = aggregates.agg_sum(star_symbol(spark, sf_dir, "agy"), KEYS)
    return charts.axis_midpoints(bars, year=TIME)


@query
def cht_legend_order(spark, sf_dir):
    return rounded(charts.legend_order(star_symbol(spark, sf_dir, "agy"), "G", reverse=True), 2)


@query
def cht_style(spark, sf_dir):
    totals = _trade(spark, sf_dir, "imports")
    return rows(
        charts.series_style(totals, "Region", META.region_series),
        YEAR, "Region", "color", "hatch", "legend",
    )


__all__ = ["QUERIES"]

"""Symbol frames derived from a star schema of order lines.

One order line is one observation of a "model run": the order priority is the scenario, the order
year is ``t``, customer and supplier regions are importer and exporter, the part type is the
sector. ``FIXTURES.md`` lists the mapping. Only the tables behind the columns a symbol needs are
joined. Two-decimal measures are summed as decimals, so results do not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenfold.functions.scalars import lookup
from scenfold.model import CASE, SCENARIO, VALUE, SymbolCatalog
from scenfold.sources.storage import cut

#: Dimensions of the fact view, by the table they come from.
ORDER_DIMS = (SCENARIO, "t")
CUSTOMER_DIMS = ("R", "GHG")
SUPPLIER_DIMS = ("RR",)
PART_DIMS = ("G", "ne")
MEASURES = ("price", "net", "qty", "disc", "tax", "n")

GRAIN = "grain"  # which grouping set a row is of

REFERENCE_SCENARIO = "1-URGENT"
#: Sector standing for oil refining.
REFINED_OIL = "LARGE"

#: Labels of the supply and demand symbol.
COMMODITY_SIDES = {"F": "supply", "O": "demand"}
FLOWS = {
    "AUTOMOBILE": "output", "BUILDING": "imports", "FURNITURE": "exports", "HOUSEHOLD": "demand",
}

SCENARIOS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


#: Declared columns of the star-schema tables: reading them needs no schema-inference job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def hundredths(col: str) -> str:
    """A two-decimal double as an exact whole number, without the slow double-to-decimal cast."""
    return f"cast(rint({col} * 100) as bigint)"


#: Columns of the order-line view, as expressions over the table that holds them.
LINE_COLUMNS = {
    "e": "l_returnflag",
    "tech": "l_linestatus",
    "price": hundredths("l_extendedprice"),
    "net": f"{hundredths('l_extendedprice')} * (100 - {hundredths('l_discount')})",
    "qty": hundredths("l_quantity"),
    "disc": hundredths("l_discount"),
    "tax": hundredths("l_tax"),
    "n": "1L",
}
ORDER_COLUMNS = {SCENARIO: "o_orderpriority", "t": "year(o_orderdate)"}
PART_COLUMNS = {"G": "p_type", "ne": "p_brand"}


def facts(spark: SparkSession, sf_dir: str, columns: Iterable[str]) -> DataFrame:
    """The order-line view with the given dimensions and measures, joining only what they need.

    Customers meet their orders before orders meet their lines, so the lines, by far the largest
    side, are shuffled once for both. Every input is cut to the columns it contributes first. No
    join is hinted: nation and region are tiny at any scale, while customer, supplier and part
    grow with the data, so Catalyst and AQE choose by size.
    """
    columns = list(dict.fromkeys(columns))
    wanted = set(columns)
    by_order = wanted & {*ORDER_DIMS, *CUSTOMER_DIMS}
    by_part = wanted & set(PART_DIMS)
    by_supplier = wanted & set(SUPPLIER_DIMS)

    def cut_to(name: str, keys: Sequence[str], expressions: Mapping[str, str]) -> DataFrame:
        kept = [f"{sql} as {col}" for col, sql in expressions.items() if col in wanted]
        return table(spark, sf_dir, name).selectExpr(*keys, *kept)

    keys = {"l_orderkey": by_order, "l_partkey": by_part, "l_suppkey": by_supplier}
    out = cut_to("lineitem", [key for key, used in keys.items() if used], LINE_COLUMNS)
    if by_order:
        by_customer = wanted & set(CUSTOMER_DIMS)
        order_keys = ["o_orderkey", "o_custkey"] if by_customer else ["o_orderkey"]
        orders = cut_to("orders", order_keys, ORDER_COLUMNS)
        if by_customer:
            customers = cut_to("customer", ["c_custkey", "c_nationkey"], {"GHG": "c_mktsegment"})
            if "R" in wanted:
                customers = _located(spark, sf_dir, customers, "c_nationkey", "R")
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if by_part:
        parts = cut_to("part", ["p_partkey"], PART_COLUMNS)
        out = out.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if by_supplier:
        suppliers = cut_to("supplier", ["s_suppkey", "s_nationkey"], {})
        suppliers = _located(spark, sf_dir, suppliers, "s_nationkey", "RR")
        out = out.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select(*columns)


def _located(
    spark: SparkSession, sf_dir: str, party: DataFrame, nation_key: str, name: str
) -> DataFrame:
    """Customers or suppliers with the name of their region."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region").selectExpr("r_regionkey", f"r_name as {name}")
    return (
        party.join(nations, F.col(nation_key) == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .drop(nation_key, "n_nationkey", "n_regionkey", "r_regionkey")
    )


#: Whole-number units per unit of a measure.
UNITS = {"price": 100.0, "net": 10_000.0, "qty": 100.0, "disc": 100.0, "tax": 100.0}


def exact_sum(name: str) -> Column:
    """Sum of whole numbers as a decimal: exact, and it cannot overflow at any scale."""
    return F.sum(F.col(name).cast("decimal(20,0)"))


def amount(name: str) -> Column:
    """Exact sum of a measure as a double."""
    return exact_sum(name).cast("double") / F.lit(UNITS[name])


def mean(name: str) -> Column:
    """Exact sum over count, rounded to 6 places. Works on rows and on partial sums alike."""
    return F.round(amount(name) / F.sum("n").cast("double"), 6)


@dataclass(frozen=True)
class SymbolSpec:
    """How a symbol follows from the fact view."""

    dims: Mapping[str, str]
    value: Callable[[], Column]
    measures: tuple[str, ...]
    where: Callable[[], Column] | None = None
    where_dims: tuple[str, ...] = ()
    constants: Mapping[str, str] = field(default_factory=dict)
    labels: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    @property
    def needs(self) -> list[str]:
        return [SCENARIO, *self.dims.values(), *self.where_dims, *self.measures]


def _dims(*names: str, **renamed: str) -> dict[str, str]:
    return {**{n: n for n in names}, **renamed}


def _total(measure: str) -> dict:
    return {"value": lambda: amount(measure), "measures": (measure,)}


def _when(col: str, label: str) -> dict:
    return {"where": lambda: F.col(col) == label, "where_dims": (col,)}




SYMBOLS: dict[str, SymbolSpec] = {
    "agy": SymbolSpec(_dims("G", "R", "t"), **_total("price")),
    "agy_bt": SymbolSpec(
        _dims("G", "R", "t"), value=lambda: F.round(amount("net"), 4), measures=("net",)
    ),
    "DPD": SymbolSpec(_dims("G", "R", "t"), value=lambda: mean("disc"), measures=("disc", "n")),
    "sco2": SymbolSpec(_dims("t", "G", "R"), **_total("qty")),
    "etotco2": SymbolSpec(_dims("G", "R", "t"), **_total("qty"), **_when("tech", "F")),
    "ei_t": SymbolSpec(_dims("e", "G", "R", "t"), **_total("price")),
    "ghgky": SymbolSpec(_dims("GHG", "G", "R", "t"), **_total("qty")),
    "ejoe": SymbolSpec(
        _dims("G", "R"), value=lambda: F.lit(1.0) + mean("tax"), measures=("tax", "n"),
        where=lambda: F.col("G") != "SMALL", where_dims=("G",),
    ),
    # The factor of an energy carrier, under the carrier's label.
    "ejoe_e": SymbolSpec(
        _dims("R", G="e"), value=lambda: F.lit(1.0) + mean("tax"), measures=("tax", "n"),
    ),
    "trad_t": SymbolSpec(_dims("G", "R", "RR", "t"), **_total("price")),
    "ee_sect": SymbolSpec(_dims("G", "R", "e", "t"), **_total("qty")),
    "ee_add": SymbolSpec(
        _dims("R", "e", "t"), **_total("qty"), **_when("tech", "O"), constants={"G": "INTERNAL"}
    ),
    "expo_t": SymbolSpec(_dims("G", "t", R="RR"), **_total("qty")),
    # Exports of an energy carrier, under the carrier's label.
    "expo_e": SymbolSpec(_dims("t", G="e", R="RR"), **_total("qty")),
    "AAI": SymbolSpec(_dims("ne", "G", "R", "t"), **_total("price")),
    "e_aai": SymbolSpec(
        _dims("G", "R", "t"), **_total("price"), **_when("tech", "F"), constants={"e": REFINED_OIL}
    ),
    "sd": SymbolSpec(
        _dims(Sector="G", Region="R", Year="t", comm="tech", flow="GHG"), **_total("price"),
        labels={"comm": COMMODITY_SIDES, "flow": FLOWS},
    ),
    "cement_out": SymbolSpec(_dims("R", "t", tech="e"), **_total("price")),
    "clinker_out": SymbolSpec(_dims("R", "t", tech="GHG"), **_total("price")),
    "liquids": SymbolSpec(_dims("R", "t", tech="e"), **_total("price")),
    "ish2t_out": SymbolSpec(_dims("R", "t"), **_total("qty"), **_when("tech", "F")),
    "isgcapt_out": SymbolSpec(_dims("R", "t"), **_total("qty"), **_when("tech", "O")),
    "data": SymbolSpec(_dims(Attribute="G", Year="t", Region="R"), **_total("price")),
    "data_brand": SymbolSpec(_dims(Attribute="ne", Year="t", Region="R"), **_total("price")),
}


def symbol_frame(base: DataFrame, spec: SymbolSpec) -> DataFrame:
    """A symbol from rows or from partial sums (sums of sums are sums)."""
    if spec.where is not None:
        base = base.filter(spec.where())
    keys = [F.col(source).alias(name) for name, source in spec.dims.items()]
    out = base.groupBy(SCENARIO, *keys).agg(spec.value().alias(VALUE))
    for name, constant in spec.constants.items():
        out = out.withColumn(name, F.lit(constant))
    for name, labels in spec.labels.items():
        out = out.withColumn(name, F.coalesce(lookup(name, labels), F.col(name)))
    return out.select(
        *spec.dims, *spec.constants, VALUE, SCENARIO, F.lit(None).cast("string").alias(CASE)
    )


def star_symbol(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One symbol, lazily: filters on its dimensions reach the order-line scan."""
    spec = SYMBOLS[name]
    return symbol_frame(facts(spark, sf_dir, spec.needs), spec)


def star_catalog(
    spark: SparkSession, sf_dir: str, aliases: Mapping[str, str] | None = None
) -> SymbolCatalog:
    """All symbols, each its own lazy plan over the tables. ``aliases`` renames: name -> source."""
    names = {**{n: n for n in SYMBOLS}, **(aliases or {})}
    return SymbolCatalog(
        {name: (lambda s=source: star_symbol(spark, sf_dir, s)) for name, source in names.items()}
    )


def shared_catalog(
    spark: SparkSession,
    sf_dir: str,
    names: Sequence[str],
    *,
    where: Column | None = None,
    where_dims: Sequence[str] = (),
    aliases: Mapping[str, str] | None = None,
) -> SymbolCatalog:
    """Several symbols from one pass over the tables.

    The fact view is read once and summed by GROUPING SETS, one for every grain that a symbol has
    (its own dimensions and those that its condition needs) and that is no part of another's: a coarser symbol is a sum of
    the rows of a finer one. What is checkpointed are such rows, not the cells of all dimensions together, which may be
    nearly as many as the facts. ``where`` restricts the pass (it may use ``where_dims`` besides the
    symbols' own dimensions).
    """
    aliases = {**{n: n for n in names}, **(aliases or {})}
    specs = {name: SYMBOLS[source] for name, source in aliases.items() if name in names}
    needs = [c for spec in specs.values() for c in spec.needs]
    base = facts(spark, sf_dir, [*needs, *where_dims])
    if where is not None:
        base = base.filter(where)
    needed = list(dict.fromkeys(needs))
    keys = [c for c in needed if c not in MEASURES]
    sums = [exact_sum(c).alias(c) for c in needed if c in MEASURES]
    grains = {name: frozenset(spec.needs) & set(keys) for name, spec in specs.items()}
    sets = [g for g in dict.fromkeys(grains.values()) if not any(g < other for other in grains.values())]
    if len(sets) == 1:
        summed = cut(base.groupBy(*keys).agg(*sums))
    else:
        listed = [[k for k in keys if k in s] for s in sets]
        summed = cut(base.groupingSets(listed, *keys).agg(F.grouping_id().alias(GRAIN), *sums))

    def grain(name: str) -> DataFrame:
        """The rows of the smallest grouping set that holds a symbol's grain.

        A set's id has a bit for every key that is not in it.
        """
        held = min((s for s in sets if grains[name] <= s), key=len)
        if len(sets) == 1:
            return summed
        bits = "".join("0" if k in held else "1" for k in keys)
        own = summed.filter(F.col(GRAIN) == int(bits, 2))
        return own.select(*[k for k in keys if k in held], *specs[name].measures)

    return SymbolCatalog({name: symbol_frame(grain(name), spec) for name, spec in specs.items()})

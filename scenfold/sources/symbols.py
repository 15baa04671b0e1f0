"""Loading scenarios into a symbol catalog (SRC-2..SRC-9).

A scenario path is a folder with one dataset per symbol (``agy.parquet`` or ``agy/``, likewise for
CSV, which may be compressed: ``agy.csv.gz``). Symbols stay lazy: loading reads file listings and
schemas (side by side, in a pool of threads), and asks Parquet footers whether a part is empty. A
loaded symbol is one scan of all its scenarios' files, however many there are. A row's scenario is
that of the folder of its file: an expression over Spark's hidden ``_metadata`` column, so a filter on ``Scenario``
or ``Case`` prunes the other scenarios' files before they are opened.

The folder of a scenario is listed, and its checkpoint folder found, through the session's JVM
gateway, so loading needs a classic session; it does not run over Spark Connect.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from scenfold.functions.literals import literal_frame
from scenfold.functions.scalars import null_if_nan
from scenfold.model import (
    CASE,
    POSITIONAL_SYMBOLS,
    SCENARIO,
    STAR_DIM,
    STAR_DIM_DEFAULT,
    STAMPS,
    SYMBOL_DIMS,
    TIME,
    VALUE,
    YEAR,
    SymbolCatalog,
)
from scenfold.operators.filters import time_range
from scenfold.operators.joins import union_all
from scenfold.sources.registry import Scenario, read_entries
from scenfold.sources.sinks import write_csv

log = logging.getLogger(__name__)

TIME_RANGE = (2020, 2100)
FORMATS = ("parquet", "csv")
COMPRESSED = ("gz", "bz2", "zst", "deflate", "snappy", "lz4")
SCHEMA_THREADS = 16
REGISTRY = "_scenarios"  # beside the symbols that save_symbols writes; no symbol, by its name
REGISTRY_SCHEMA = "scenario string, case string, path string, ord int"
PROBED = 32  # parts whose footers one query counts


def dataset_name(name: str) -> tuple[str, str] | None:
    """Symbol and format of a file or folder by its suffix; None for what is no dataset."""
    if name.startswith(("_", ".")):
        return None
    stem, dot, suffix = name.rpartition(".")
    if dot and suffix in COMPRESSED:
        stem, dot, suffix = stem.rpartition(".")
        if suffix != "csv":
            return None
    if not dot:
        return name, "parquet"
    return (stem, suffix) if stem and suffix in FORMATS else None


FLAT, FILE, NESTED = "flat", "file", "nested"


def layout(fs, status) -> str:
    """How a dataset is stored: one file, a folder of files, or folders in a folder."""
    if not status.isDirectory():
        return FILE
    inner = [s for s in fs.listStatus(status.getPath()) if s.isDirectory()]
    hidden = all(s.getPath().getName().startswith(("_", ".")) for s in inner)
    return FLAT if hidden else NESTED


def list_symbols(spark: SparkSession, path: str) -> dict[str, tuple[str, str, str, str]] | None:
    """Symbol name -> (path, format, layout, URI) in a scenario folder; None when there is no folder.

    Uses the Hadoop file system of the path, so it works on any store the cluster can reach.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    found = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        known = dataset_name(name)
        if known is None:
            if not name.startswith(("_", ".")):
                log.warning("%s is not a dataset of a known format, skipped", status.getPath())
            continue
        symbol, fmt = known
        if symbol in found:
            raise ValueError(f"two datasets of symbol {symbol}: {found[symbol][0]} and {name}")
        location = status.getPath()
        found[symbol] = (location.toString(), fmt, layout(fs, status), location.toUri().toString())
    return found


def stamp(df: DataFrame, scenario: str, case: str | None) -> DataFrame:
    """SRC-3: constant scenario and case columns."""
    return df.withColumn(SCENARIO, F.lit(scenario)).withColumn(CASE, F.lit(case).cast("string"))


def unstamped(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in STAMPS]


def has_rows(df: DataFrame) -> DataFrame:
    """At most one row, from the part if any of its dimensions or values is not missing."""
    filled = F.lit(False)
    for col in unstamped(df):
        filled = filled | F.col(f"`{col}`").isNotNull()
    return df.filter(filled).limit(1)


def drop_empty(parts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """SRC-4: leave out scenario parts without data. One job probes all parts at once."""
    probes = [has_rows(df).select(F.lit(name).alias("name")) for name, df in parts.items()]
    if not probes:
        return {}
    found = {row["name"] for row in union_all(*probes).collect()}
    return {name: df for name, df in parts.items() if name in found}


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which Parquet answers counts from its footers.

    Spark pushes aggregates only into its newer Parquet reader; the setting stays in this session.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def filled_counts(spark: SparkSession, parts: Mapping[str, tuple[str, StructType]]) -> DataFrame:
    """``(name, counts)``: of each Parquet dataset, how many values of each column are not null.

    ``spark`` is a ``footer_session``: the counts come from footers, no row is decoded.
    """
    rows = []
    for name, (location, schema) in parts.items():
        counts = [F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(schema)]
        counted = spark.read.schema(schema).parquet(location).agg(*counts)
        listed = F.array(*[F.col(f"c{i}") for i in range(len(schema))])
        rows.append(counted.select(F.lit(name).alias("name"), listed.alias("counts")))
    return union_all(*rows)


def without_empty(
    spark: SparkSession,
    parts: Sequence[Part],
    frames: Mapping[str, DataFrame],
    cleaned: Mapping[str, DataFrame],
) -> set[str]:
    """SRC-4 by footers: the scenarios whose part has a dimension or value that is not missing.

    A part is probed by a row only where footers cannot tell: it is no Parquet, or nothing but doubles, of
    which NaN counts as missing, are not null. ``cleaned`` are the frames with such values NULL.
    """
    asked = {
        p.scenario.name: (p.path, frames[p.scenario.name].schema) for p in parts if p.fmt == "parquet"
    }
    names, kept = list(asked), set()
    chunks = [names[i : i + PROBED] for i in range(0, len(names), PROBED)]
    session = footer_session(spark)
    with ThreadPoolExecutor(SCHEMA_THREADS) as pool:
        found = pool.map(
            lambda chunk: filled_counts(session, {n: asked[n] for n in chunk}).collect(), chunks
        )
    open_ = {p.scenario.name for p in parts} - asked.keys()
    for row in (r for rows in found for r in rows):
        fields = asked[row["name"]][1].fields
        exact = [n for f, n in zip(fields, row["counts"], strict=True) if not is_measure(f)]
        if any(exact):
            kept.add(row["name"])
        elif any(row["counts"]):
            open_.add(row["name"])
    return kept | drop_empty({n: df for n, df in cleaned.items() if n in open_}).keys()


def is_measure(f: StructField) -> bool:
    """Could a value that is not null count as missing?"""
    return f.name == VALUE or isinstance(f.dataType, DoubleType | FloatType)


def same_schema(parts: Sequence[DataFrame]) -> bool:
    """SRC-5: do all parts have the same columns in the same order? Metadata only."""
    return len({tuple(df.columns) for df in parts}) <= 1


def has_measure(df: DataFrame) -> bool:
    """SRC-6: at least one dimension and a measure besides the stamps."""
    return len(unstamped(df)) >= 2


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """SRC-7: new names by position."""
    return df.toDF(*names)


def rename_symbol(name: str, df: DataFrame) -> DataFrame:
    """Positional names where the symbol has them; otherwise name an undeclared dimension."""
    if name in POSITIONAL_SYMBOLS:
        return rename_positional(df, [*SYMBOL_DIMS[name], VALUE])
    if "*" in df.columns:
        return df.withColumnRenamed("*", STAR_DIM.get(name, STAR_DIM_DEFAULT))
    return df


def rename_stamped(name: str, df: DataFrame) -> DataFrame:
    """``rename_symbol`` of a frame that ends in the stamps."""
    if name in POSITIONAL_SYMBOLS:
        return rename_positional(df, [*SYMBOL_DIMS[name], VALUE, *STAMPS])
    return rename_symbol(name, df)


def clean(df: DataFrame) -> DataFrame:
    """The measure as a double, NULL where it is NaN or no number; once, at load, after renaming."""
    if VALUE in df.columns:
        return df.withColumn(VALUE, null_if_nan(F.col(VALUE).try_cast("double")))
    return df


@dataclass(frozen=True)
class Part:
    """One scenario's dataset of one symbol."""

    scenario: Scenario
    path: str
    fmt: str
    layout: str = NESTED
    uri: str = ""  # the path as Spark's ``_metadata.file_path`` spells it


def read_part(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One scenario's dataset of one symbol. CSV columns are strings until they are cleaned."""
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


def read_parts(spark: SparkSession, parts: Sequence[Part]) -> dict[str, DataFrame]:
    """All scenarios' datasets of one symbol, one by one; their schemas are read side by side."""
    with ThreadPoolExecutor(SCHEMA_THREADS) as pool:
        frames = pool.map(lambda part: read_part(spark, part.path, part.fmt), parts)
        return {part.scenario.name: df for part, df in zip(parts, frames, strict=True)}


def in_table(key: Column, keys: Sequence[str], values: Column) -> Column:
    """The element of ``values`` at the place of ``key`` among the sorted ``keys``; NULL if it is not there.

    A binary search over a constant array: the expression stays small however many keys there are.
    """
    table = F.from_json(F.lit(json.dumps(list(keys))), "array<string>")  # folded into one literal
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(keys).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at)

    at = F.aggregate(steps, F.lit(0), further)
    return F.transform(
        F.array(at), lambda place: F.when(F.get(table, place - 1) == key, F.get(values, place - 1))
    )[0]


def spellings(uri: str) -> tuple[str, ...]:
    """How a file's path may be spelt: without authority, ``file:/x`` is ``file:///x``."""
    scheme, colon, path = uri.partition(":")
    rest = path.lstrip("/")
    if not colon or path.startswith("//") and not path.startswith("///"):
        return (uri,)
    return f"{scheme}:/{rest}", f"{scheme}:///{rest}"


def one_scan(spark: SparkSession, parts: Sequence[Part], schema: StructType) -> DataFrame:
    """The parts, of one format and schema, in a single scan, with their stamps.

    Every row finds its scenario by the folder of its file (by the file, where a dataset is one). Scenarios that name
    the same dataset each have its rows.
    """
    owners: dict[str, list[Scenario]] = {}
    for part in parts:
        owners.setdefault(part.uri, []).append(part.scenario)
    reader = spark.read.schema(schema).format(parts[0].fmt).option("header", True)
    paths = list(dict.fromkeys(p.path for p in parts))
    scan = reader.load(paths).select("*", F.col("_metadata.file_path").alias("__file"))
    file = F.col("__file")
    name = F.substring_index(file, "/", -1)
    folder = F.substring(file, F.lit(1), F.length(file) - F.length(name) - 1)

    def owner(key_of_row: Column, wanted: str) -> Column | None:
        owned_by = {key: p.uri for p in parts if p.layout == wanted for key in spellings(p.uri)}
        keys = sorted(owned_by)
        if not keys:
            return None
        stamps = [
            [{SCENARIO: s.name, CASE: s.case} for s in owners[owned_by[key]]] for key in keys
        ]
        kind = f"array<array<struct<{SCENARIO}:string,{CASE}:string>>>"
        return in_table(key_of_row, keys, F.from_json(F.lit(json.dumps(stamps)), kind))

    found = [c for c in (owner(folder, FLAT), owner(file, FILE)) if c is not None]
    owned = scan.withColumn("__owners", F.coalesce(*found)).drop("__file")
    shared = any(len(s) > 1 for s in owners.values())
    stamps = F.explode("__owners") if shared else F.get(F.col("__owners"), F.lit(0))
    kept = [c for c in schema.fieldNames() if c not in STAMPS]
    stamped = owned.select(*[f"`{c}`" for c in kept], stamps.alias("__stamps"))
    return stamped.select(*[f"`{c}`" for c in kept], f"__stamps.{SCENARIO}", f"__stamps.{CASE}")


def stacked_parts(
    spark: SparkSession, parts: Sequence[Part], frames: Mapping[str, DataFrame]
) -> DataFrame:
    """The stamped parts of one symbol: one scan for each format and schema there is.

    Only a dataset with folders in its folder, whose partition columns are its own, is a scan of its own.
    """
    scans: dict[tuple, list[Part]] = {}
    for part in parts:
        df = frames[part.scenario.name]
        own = part.path if part.layout == NESTED else None
        scans.setdefault((part.fmt, tuple(df.dtypes), own), []).append(part)
    stacked = []
    for (_, _, own), group in scans.items():
        first = frames[group[0].scenario.name]
        if own is None:
            stacked.append(one_scan(spark, group, first.schema))
        else:
            stacked += [stamp(frames[p.scenario.name], p.scenario.name, p.scenario.case) for p in group]
    return union_all(*stacked)


def prepared(name: str, df: DataFrame) -> DataFrame:
    """Source columns under their final names, with a clean measure.

    A part whose columns do not fit the symbol's positions stays as it is, for the gates to refuse.
    """
    if name in POSITIONAL_SYMBOLS and len(df.columns) != len(SYMBOL_DIMS[name]) + 1:
        return df
    return clean(rename_symbol(name, df))


def refusal(name: str, frames: Sequence[DataFrame]) -> str | None:
    """SRC-5, SRC-6: why the parts of a symbol, as they were read, are not stacked; None if they are."""
    if not frames:
        return "no data"
    if not same_schema(frames):
        return "different columns across scenarios"
    first = prepared(name, frames[0])
    if not has_measure(first):
        return "fewer than two columns"
    if name in POSITIONAL_SYMBOLS and VALUE not in first.columns:
        return "not the columns of its positions"
    return None


def load_symbol(
    spark: SparkSession,
    name: str,
    parts: Sequence[Part],
    time: tuple[int, int] = TIME_RANGE,
    *,
    check_empty: bool = True,
) -> DataFrame | None:
    """Gate, rename, stamp and stack the parts of one symbol; None when it is rejected."""
    frames = read_parts(spark, parts)
    if check_empty:
        cleaned = {scenario: prepared(name, df) for scenario, df in frames.items()}
        kept = without_empty(spark, parts, frames, cleaned)
        parts = [p for p in parts if p.scenario.name in kept]
    reason = refusal(name, [frames[p.scenario.name] for p in parts])
    if reason is not None:
        log.warning("symbol %s has %s, skipped", name, reason)
        return None
    stacked = stacked_parts(spark, parts, frames)
    stamps = stacked.select(*unstamped(stacked), *STAMPS)
    stacked = clean(rename_stamped(name, stamps))
    for col in (TIME, YEAR):
        if col in stacked.columns:
            stacked = time_range(stacked, col, *time)
    return stacked


def gate_report(
    spark: SparkSession,
    entries: Mapping[str, str | Mapping[str, str] | None],
    symbols: Sequence[str] | None = None,
) -> DataFrame:
    """SRC-5, SRC-6: ``(symbol, accepted, reason)`` of every symbol that the scenarios have.

    Reads schemas only; emptiness is not asked for.
    """
    rows = []
    for name, parts in sorted(parts_by_symbol(spark, entries, symbols).items()):
        frames = read_parts(spark, parts)
        reason = refusal(name, list(frames.values()))
        rows.append((name, reason is None, reason))
    return literal_frame(spark, "symbol string, accepted boolean, reason string", rows)


def parts_by_symbol(
    spark: SparkSession,
    entries: Mapping[str, str | Mapping[str, str] | None],
    symbols: Sequence[str] | None = None,
    *,
    verbose: bool = False,
) -> dict[str, list[Part]]:
    """Every symbol's datasets in the scenario folders that exist."""
    found: dict[str, list[Part]] = {}
    scenarios = read_entries(entries)
    with ThreadPoolExecutor(SCHEMA_THREADS) as pool:
        folders = list(pool.map(lambda s: list_symbols(spark, s.path) if s.path else None, scenarios))
    for scenario, datasets in zip(scenarios, folders, strict=True):
        if datasets is None:
            if verbose:
                log.warning("scenario %s: missing path %s", scenario.name, scenario.path)
            continue
        for name, stored in datasets.items():
            if symbols is None or name in symbols:
                found.setdefault(name, []).append(Part(scenario, *stored))
    return found


def load_scenarios(
    spark: SparkSession,
    entries: Mapping[str, str | Mapping[str, str] | None],
    time: tuple[int, int] = TIME_RANGE,
    *,
    symbols: Sequence[str] | None = None,
    check_empty: bool = True,
    verbose: bool = False,
    csv: str | None = None,
) -> SymbolCatalog:
    """SRC-2: every symbol of every reachable scenario, as a catalog of lazy frames.

    Missing paths are skipped (and logged with ``verbose``). ``symbols`` restricts what is opened.
    ``csv`` is a folder to write the reporting table to, if there is one.
    """
    found = parts_by_symbol(spark, entries, symbols, verbose=verbose)
    loaded = {
        name: load_symbol(spark, name, parts, time, check_empty=check_empty)
        for name, parts in found.items()
    }
    catalog = SymbolCatalog({name: df for name, df in loaded.items() if df is not None})
    if csv is not None and (table := reporting_table(catalog, time)) is not None:
        write_csv(table, csv)
    return catalog


def reporting_table(
    catalog: Mapping[str, DataFrame], time: tuple[int, int] = TIME_RANGE
) -> DataFrame | None:
    """SRC-9: the symbol ``data`` as (Attribute, Year, Region, Value, Scenario, Case)."""
    if "data" not in catalog:
        return None
    table = rename_positional(catalog["data"], [*SYMBOL_DIMS["data"], VALUE, *STAMPS])
    return time_range(table, YEAR, *time)


def save_symbols(
    catalog: Mapping[str, DataFrame],
    path: str,
    mode: str = "errorifexists",
    *,
    registry: DataFrame | None = None,
) -> None:
    """Write each symbol as Parquet partitioned by scenario, for pruned reads of many scenarios.

    The registry is written beside them, so that scenarios can be chosen by what it says of them.
    """
    for name, df in catalog.items():
        df.write.mode(mode).partitionBy(SCENARIO).parquet(f"{path}/{name}")
    if registry is not None:
        registry.write.mode(mode).parquet(f"{path}/{REGISTRY}")


def open_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry that ``save_symbols`` has written."""
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{path}/{REGISTRY}")


def of_case(df: DataFrame, registry: DataFrame, case: str) -> DataFrame:
    """SRC-3: the rows of the scenarios that the registry has under a case, which is put in ``Case``.

    The scenarios come from the registry while the query runs; over a dataset partitioned by scenario, Spark
    prunes the folders of all others by them (dynamic partition pruning).
    """
    chosen = registry.filter(F.col("case") == case).select(F.col("scenario").alias("__scenario"))
    kept = df.join(chosen, F.col(SCENARIO) == F.col("__scenario"), "left_semi")
    return kept.withColumn(CASE, F.lit(case))


def open_symbols(spark: SparkSession, path: str) -> SymbolCatalog:
    """The catalog over a folder written by ``save_symbols``; symbols open on first use."""
    datasets = list_symbols(spark, path) or {}

    def reader(location: str):
        def read() -> DataFrame:
            # Declared, because partition discovery would turn a scenario called "2050" into a number.
            fields = [
                StructField(SCENARIO, StringType()) if f.name == SCENARIO else f
                for f in spark.read.parquet(location).schema
            ]
            return spark.read.schema(StructType(fields)).parquet(location)

        return read

    return SymbolCatalog({name: reader(location) for name, (location, *_) in datasets.items()})

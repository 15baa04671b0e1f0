"""Data model: column names, symbol schemas and the symbol catalog.

A *symbol* is one model parameter, stacked over all scenarios into a long frame of string
dimension columns, an integer year and one double ``Value``. The *reporting table* is the symbol
``data`` with the columns ``Attribute, Year, Region``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

SCENARIO = "Scenario"
CASE = "Case"
TIME = "t"
YEAR = "Year"
VALUE = "Value"
STAMPS = (SCENARIO, CASE)

#: Dimension columns of the symbols the analyses read, in source order.
SYMBOL_DIMS: dict[str, tuple[str, ...]] = {
    "data": ("Attribute", "Year", "Region"),
    "agy": ("G", "R", "t"),
    "agy_bt": ("G", "R", "t"),
    "sco2": ("t", "G", "R"),
    "etotco2": ("G", "R", "t"),
    "ACCA": ("R", "G", "t"),
    "ei_t": ("e", "G", "R", "t"),
    "e_aai": ("e", "G", "R", "t"),
    "AAI": ("ne", "G", "R", "t"),
    "ee_sect": ("G", "R", "e", "t"),
    "ee_add": ("G", "R", "e", "t"),
    "expo_t": ("G", "R", "t"),
    "ejoe": ("G", "R"),
    "ghgky": ("GHG", "G", "R", "t"),
    "trad_t": ("G", "R", "RR", "t"),
    "sd": ("Sector", "Region", "Year", "comm", "flow"),
    "nmm_out": ("tech", "R", "t"),
    "liquids": ("tech", "R", "t"),
    "ish2t_out": ("R", "t"),
    "isgcapt_out": ("R", "t"),
}

#: Symbols whose source columns carry no usable names: they are renamed by position.
POSITIONAL_SYMBOLS = ("sco2", "ACCA", "etotco2", "data", "sd")

#: What an undeclared dimension (a column literally called ``*``) means, per symbol.
STAR_DIM = {"nmm_out": "tech", "liquids": "tech"}
STAR_DIM_DEFAULT = "G"


def symbol_schema(name: str) -> StructType:
    """StructType of a known symbol, stamps included."""
    dims = [
        StructField(d, IntegerType() if d in (TIME, YEAR) else StringType())
        for d in SYMBOL_DIMS[name]
    ]
    return StructType(
        [
            *dims,
            StructField(VALUE, DoubleType()),
            StructField(SCENARIO, StringType(), nullable=False),
            StructField(CASE, StringType()),
        ]
    )


class SymbolCatalog(Mapping[str, DataFrame]):
    """Symbol name -> lazy DataFrame.

    Entries may be DataFrames or zero-argument builders; a builder runs on first use, so opening
    a catalog of many symbols costs nothing for those an analysis never reads.
    """

    def __init__(self, entries: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._entries = dict(entries)

    def __getitem__(self, name: str) -> DataFrame:
        entry = self._entries[name]
        if callable(entry):
            entry = self._entries[name] = entry()
        return entry

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def __contains__(self, name: object) -> bool:
        return name in self._entries

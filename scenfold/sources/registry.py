"""SRC-1: the scenario registry."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scenfold.functions.literals import literal_frame


@dataclass(frozen=True)
class Scenario:
    name: str
    path: str | None
    case: str | None
    ord: int


def read_entries(entries: Mapping[str, str | Mapping[str, str] | None]) -> list[Scenario]:
    """Flat (``name -> path``) or nested (``name -> {path, case}``) entries, in given order.

    Nested entries name their path ``path`` or ``gdx``. Flat ones have no case.
    """
    out = []
    for position, (name, entry) in enumerate(entries.items()):
        if isinstance(entry, Mapping):
            out.append(Scenario(name, entry.get("path", entry.get("gdx")), entry.get("case"), position))
        else:
            out.append(Scenario(name, entry, None, position))
    return out


def scenario_registry(
    spark: SparkSession, entries: Mapping[str, str | Mapping[str, str] | None]
) -> DataFrame:
    """The registry as a literal frame ``(scenario, case, path, ord)``."""
    rows = [(s.name, s.case, s.path, s.ord) for s in read_entries(entries)]
    return literal_frame(spark, "scenario string, case string, path string, ord int", rows)

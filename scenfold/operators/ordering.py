"""Sorting (SRT-*). Sorts belong at the sink: every function here ends a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenfold.model import SCENARIO, TIME, VALUE
from scenfold.operators.aggregates import series_total
from scenfold.sources.storage import cut


#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_PLACE_BITS = 33


def numbered(df: DataFrame, *keys: str, name: str = "position", first: int = 1) -> DataFrame:
    """Rows in the order of ``keys`` with their position among all rows.

    Rows are dealt in ranges of the keys and sorted within; a row's position is its place in its range
    after all rows of earlier ranges. Only the ranges' row counts, one for each, meet in
    the driver. The sorted rows are checkpointed, so that places stay as they were counted.
    Rows with equal keys are in an order of their own.
    """
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(ranges.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", _PLACE_BITS).cast("int")
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).count().collect()}
    before, starts = first, []
    for number in range(max(counts, default=0) + 1):
        starts.append(before)
        before += counts.get(number, 0)
    start = F.get(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), part)
    place = F.col("__place") - F.shiftleft(part.cast("long"), _PLACE_BITS)
    return placed.withColumn(name, start + place).drop("__place")


def sorted_by(df: DataFrame, *keys: str, position: str | None = None) -> DataFrame:
    """SRT-1: ascending; with ``position``, the rows' places from 1 in a column of that name."""
    keys = keys or (SCENARIO, TIME)
    return df.orderBy(*keys) if position is None else numbered(df, *keys, name=position)


def by_total_desc(
    df: DataFrame, series: str, value: str = VALUE, *, reverse: bool = False
) -> DataFrame:
    """SRT-2: series with their totals, largest first; ties by name. ``reverse`` is SRT-3 of that."""
    totals = series_total(df, series, value)
    if reverse:
        return totals.orderBy(F.asc(value), F.desc(series))
    return totals.orderBy(F.desc(value), F.asc(series))


def reverse_order(df: DataFrame, *keys: str) -> DataFrame:
    """SRT-3: descending."""
    return df.orderBy(*[F.desc(k) for k in keys])


def by_registry(
    df: DataFrame, registry: DataFrame, time: str = TIME, *, ranks: bool = False
) -> DataFrame:
    """SRT-4: scenarios in the order they were registered, then by year.

    ``ranks`` adds the scenario's place in the registry and the row's within the scenario, as
    ``ord`` and ``position``. The registry joins by its size, without a hint.
    """
    ordered = registry.select(F.col("scenario").alias("__s"), F.col("ord").alias("__ord"))
    placed = df.join(ordered, F.col(SCENARIO) == F.col("__s"), "left")
    if ranks:
        inside = Window.partitionBy(SCENARIO).orderBy(time)
        placed = placed.withColumns(
            {"ord": F.col("__ord"), "position": F.row_number().over(inside)}
        )
    return placed.orderBy("__ord", time).drop("__s", "__ord")

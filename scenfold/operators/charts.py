"""Data behind stacked and grouped charts (CHT-*, AGG-9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scenfold.functions.literals import literal_frame
from scenfold.functions.scalars import neg, pos, zero_if_null
from scenfold.model import SCENARIO, VALUE, YEAR
from scenfold.operators.aggregates import agg_sum
from scenfold.operators.ordering import by_total_desc, numbered

#: Fallback colors: trade and generation charts, and GDP charts.
DEFAULT_COLOR = "#999999"
DEFAULT_GDP_COLOR = "#CCCCCC"


def stack_offsets(
    df: DataFrame,
    series: str,
    order: Sequence[str],
    *,
    signed: bool = False,
    keys: Sequence[str] = (SCENARIO, YEAR),
    value: str = VALUE,
) -> DataFrame:
    """CHT-1, CHT-2: where each series starts in its stacked bar.

    Series stack in ``order``; unlisted ones follow by name. With ``signed`` the positive and the
    negative parts stack separately. The frame is first summed to one row per bar and series.
    """
    ranks = literal_frame(
        df.sparkSession, f"{series} string, __rank int", [(s, i) for i, s in enumerate(order)]
    )
    cells = agg_sum(df, [*keys, series], value).join(F.broadcast(ranks), series, "left")
    below = (
        Window.partitionBy(*keys)
        .orderBy(F.asc_nulls_last("__rank"), F.asc(series))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    filled = zero_if_null(value)
    if not signed:
        return cells.select(
            *keys, series, filled.alias(value), F.coalesce(F.sum(filled).over(below), F.lit(0.0)).alias("bottom")
        )
    return cells.select(
        *keys,
        series,
        pos(value).alias("positive"),
        neg(value).alias("negative"),
        F.coalesce(F.sum(pos(value)).over(below), F.lit(0.0)).alias("bottom_positive"),
        F.coalesce(F.sum(neg(value)).over(below), F.lit(0.0)).alias("bottom_negative"),
    )


def axis_midpoints(
    df: DataFrame, *, scenario: str = SCENARIO, year: str = YEAR, order: str | None = None
) -> DataFrame:
    """CHT-3, AGG-9: mean bar position per scenario, bars counted from 0.

    Bars sort by scenario, then year. They are numbered in ranges, never in one task.
    ``order`` names a column with the scenario rank (registry order), by default the name itself.
    A scenario whose years are all missing has no bars and no position.
    """
    of_scenario = Window.partitionBy(scenario)  # its years
    bars = df.groupBy(scenario, year).agg(F.min(order or scenario).alias("__rank"))
    known = bars.withColumn("__first", F.min("__rank").over(of_scenario)).filter(F.col(year).isNotNull())
    placed = numbered(known, "__first", scenario, year, name="__bar", first=0)
    return placed.groupBy(scenario).agg(
        F.count("*").alias("bars"), F.avg("__bar").alias("position")
    )


def legend_order(
    df: DataFrame, series: str, value: str = VALUE, *, reverse: bool = False
) -> DataFrame:
    """CHT-4: series with their totals, largest first, or smallest first as legends list them."""
    return by_total_desc(df, series, value, reverse=reverse)


def series_style(
    df: DataFrame,
    series: str,
    styles: Mapping[str, tuple],
    default: str = DEFAULT_COLOR,
) -> DataFrame:
    """CHT-5: color, hatch and legend per series, with a default color for unknown ones.

    ``styles`` maps a series to ``(color, hatch, legend)``.
    """
    table = literal_frame(
        df.sparkSession,
        f"{series} string, color string, hatch string, legend string",
        [(name, *style) for name, style in styles.items()],
    )
    return (
        df.join(F.broadcast(table), series, "left")
        .withColumn("color", F.coalesce("color", F.lit(default)))
        .withColumn("hatch", F.coalesce("hatch", F.lit("")))
        .withColumn("legend", F.coalesce("legend", series))
    )

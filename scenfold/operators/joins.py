"""Joins and aligned arithmetic (JOIN-*, SET-1, LIM-1)."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scenfold.functions.literals import literal_frame
from scenfold.functions.scalars import safe_div
from scenfold.model import SCENARIO, TIME, VALUE

_PART = "__part"
MISSING = "(missing)"


def union_all(*frames: DataFrame) -> DataFrame:
    """SET-1: stack frames by column name; a column missing in one is NULL there.

    Halves are stacked first, so the plan of many frames is flat enough to analyse.
    """
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return union_all(*frames[:half]).unionByName(union_all(*frames[half:]), allowMissingColumns=True)


def first_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """LIM-1: the row with the smallest ``order`` per key, in one aggregate.

    Rows with an equal ``order`` are told apart by their other columns; a missing one comes last.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("first"), F.struct(*rest).alias("row"))
    picked = df.groupBy(*keys).agg(F.min(ranked).alias("__row"))
    return picked.select(*keys, "__row.row.*")


def left_on(
    df: DataFrame, other: DataFrame, keys: Sequence[str] = (SCENARIO, TIME)
) -> DataFrame:
    """JOIN-1: left merge on the given keys."""
    return df.join(other, list(keys), "left")


def parts_of(
    df: DataFrame,
    labels: Sequence[tuple[str, Column]],
    keys: Sequence[str] = (SCENARIO, TIME),
    value: str = VALUE,
) -> DataFrame:
    """Rows of one frame as rows of several parts: each row once per part whose test it passes.

    Serves ``side_by_side(shared=...)``: parts that come from the same symbol then share its scan.
    """
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in labels]))
    return df.select(*keys, F.col(value).cast("double").alias(value), F.explode(names).alias(_PART))


def side_by_side(
    parts: Mapping[str, DataFrame],
    keys: Sequence[str] = (SCENARIO, TIME),
    value: str = VALUE,
    *,
    averaged: Collection[str] = (),
    shared: Mapping[tuple[str, ...], DataFrame] | None = None,
) -> DataFrame:
    """One column per part, aligned on ``keys``: JOIN-4..7 without a join.

    The tagged rows of all parts are stacked and summed per tag (averaged for the parts named in
    ``averaged``) in a single aggregate. Parts need no aggregation of their own, so N parts cost
    one shuffle with map-side combine instead of N shuffles and N-1 joins, and a hot key cannot
    skew a join. A part without rows for a key is NULL there; a sum of only missing values is 0.
    ``shared`` adds frames from ``parts_of``, under the names of the parts they hold.
    """
    shared = shared or {}
    own_value = F.col(value).cast("double").alias(value)
    stacked = union_all(
        *[df.select(*keys, own_value, F.lit(name).alias(_PART)) for name, df in parts.items()],
        *shared.values(),
    )
    columns = []
    for name in [*parts, *chain.from_iterable(shared)]:
        mine = F.col(_PART) == F.lit(name)
        own = F.when(mine, F.col(value))
        if name in averaged:
            columns.append(F.avg(own).alias(name))
        else:
            columns.append(F.when(F.max(mine), F.coalesce(F.sum(own), F.lit(0.0))).alias(name))
    return stacked.groupBy(*keys).agg(*columns)


_OPS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": safe_div,
}


def align(
    a: DataFrame,
    b: DataFrame,
    op: str,
    keys: Sequence[str] = (SCENARIO, TIME),
    value: str = VALUE,
) -> DataFrame:
    """JOIN-4: frame arithmetic by key. NULL where either side has no row."""
    both = side_by_side({"__a": a, "__b": b}, keys, value)
    return both.select(*keys, _OPS[op](F.col("__a"), F.col("__b")).alias(value))


def per_total(
    df: DataFrame,
    totals: DataFrame,
    keys: Sequence[str] = (SCENARIO, TIME),
    value: str = VALUE,
) -> DataFrame:
    """JOIN-7: value per unit of a total with the same keys; rows follow ``df``."""
    both = side_by_side({"__a": df, "__b": totals}, keys, value)
    return both.filter(F.col("__a").isNotNull()).select(
        *keys, safe_div(F.col("__a"), F.col("__b")).alias(value)
    )


def convert(
    df: DataFrame,
    factors: Mapping[str, float],
    *,
    on: str = "R",
    value: str = VALUE,
    strict: bool = False,
    observed: Observation | None = None,
) -> DataFrame:
    """JOIN-2: divide by the factor of the row's region through a broadcast join.

    ``factors`` is the conversion table of one sector. A region without a factor gives NULL;
    with ``strict`` the running query fails instead, without a separate counting job.
    ``observed`` counts such rows, and lists their regions, while the query runs (Q23): after its action,
    ``require_matched`` fails with all of them.
    """
    table = literal_frame(
        df.sparkSession, f"{on} string, __factor double", list(factors.items())
    )
    factor = F.col("__factor")
    if strict:
        factor = F.coalesce(
            factor,
            F.raise_error(F.concat(F.lit("no conversion factor for "), F.col(on))).cast("double"),
        )
    joined = df.join(F.broadcast(table), on, "left")
    if observed is not None:
        unmatched = F.col("__factor").isNull()
        label = F.coalesce(F.col(on), F.lit(MISSING))
        joined = joined.observe(
            observed,
            F.count("*").alias("rows"),
            F.count_if(unmatched).alias("unmatched"),
            F.sort_array(F.collect_set(F.when(unmatched, label))).alias("labels"),
        )
    return joined.withColumn(value, safe_div(F.col(value), factor)).drop("__factor")


def require_matched(observed: Observation) -> dict[str, Any]:
    """The counts of a ``convert`` whose action has run; ValueError if rows had no factor."""
    counts = observed.get
    if counts["unmatched"]:
        listed = ", ".join(counts["labels"])
        raise ValueError(
            f"no conversion factor for {counts['unmatched']} of {counts['rows']} rows: {listed}"
        )
    return counts


def unmatched_rows(
    df: DataFrame, factors: Mapping[str, float], keys: Sequence[str] = (), *, on: str = "R"
) -> DataFrame:
    """JOIN-2: how many rows ``convert`` would leave without a factor, by ``on`` and ``keys``."""
    known = F.coalesce(F.col(on).isin(list(factors)), F.lit(False))
    return df.filter(~known).groupBy(on, *keys).agg(F.count("*").alias("unmatched"))


def with_factor(
    df: DataFrame,
    factors: DataFrame,
    keys: Sequence[str] = (SCENARIO, "R"),
    *,
    default: float | None = None,
    name: str = "factor",
    value: str = VALUE,
) -> DataFrame:
    """JOIN-3: attach a factor per key, with an optional default where there is none.

    A key with several factors has the least of them (``first_by``), so no row of ``df`` is
    multiplied. No broadcast hint: the factor frame is data, so Catalyst broadcasts it by its size.
    """
    table = first_by(factors.select(*keys, F.col(value).alias(name)), keys, name)
    out = df.join(table, list(keys), "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))

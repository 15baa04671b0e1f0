"""Scenario comparison (CMP-*).

These run on a frame already summed to the analysis grain, so their windows span the years of one
scenario, the scenarios of one year or the series of one bar, never raw rows. Side conditions (the
first year, whether the reference exists) are scalar subqueries over the same frame: no job runs
while the plan is built. The named analyses checkpoint that small frame first (``storage.cut``),
so the two readers do not compute it twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scenfold.functions.scalars import safe_div
from scenfold.model import SCENARIO, TIME, VALUE
from scenfold.operators.aggregates import agg_sum, with_total

REFERENCE = "Ref"
DIFFERENCE_LABEL = "Difference between two scenarios"


def _scalar(df: DataFrame, aggregate: Column) -> Column:
    return df.agg(aggregate.alias("__x")).scalar()


def rebase(
    df: DataFrame,
    base: float = 100.0,
    *,
    by: Sequence[str] = (SCENARIO,),
    time: str = TIME,
    value: str = VALUE,
    base_year: int | None = None,
) -> DataFrame:
    """CMP-1: each scenario over its own value in the first year of the frame, times ``base``.

    The base year is the smallest year of the whole frame: a scenario that starts later, or is 0
    there, becomes NULL. Passing ``base_year`` skips the subquery that finds it.
    """
    first = F.lit(base_year) if base_year is not None else _scalar(df, F.min(time))
    at_base = F.max(F.when(F.col(time) == first, F.col(value)))
    return df.withColumn("__base", at_base.over(Window.partitionBy(*by))).select(
        *[c for c in df.columns if c != value],
        (safe_div(F.col(value), F.col("__base")) * F.lit(float(base))).alias(value),
    )


def reldiff(
    df: DataFrame,
    ref: str = REFERENCE,
    *,
    by: Sequence[str] = (TIME,),
    scenario: str = SCENARIO,
    value: str = VALUE,
) -> DataFrame:
    """CMP-2: percent difference from the reference scenario, which is then dropped.

    NULL where the reference is missing or 0. The query fails when the frame holds no reference
    at all.
    """
    exists = _scalar(df, F.max(F.col(scenario) == F.lit(ref)))
    at_ref = F.max(F.when(F.col(scenario) == F.lit(ref), F.col(value)))
    percent = safe_div(F.col(value) - F.col("__ref"), F.col("__ref")) * 100.0
    missing = F.raise_error(F.lit(f"reference scenario {ref!r} not found")).cast("double")
    return (
        df.withColumn("__ref", at_ref.over(Window.partitionBy(*by)))
        .filter(F.col(scenario) != F.lit(ref))
        .select(
            *[c for c in df.columns if c != value],
            F.when(exists, percent).otherwise(missing).alias(value),
        )
    )


def row_share(
    df: DataFrame,
    scale: float = 100.0,
    *,
    keys: Sequence[str] = (SCENARIO, TIME),
    value: str = VALUE,
) -> DataFrame:
    """CMP-4: share of each series in the total of its bar; missing series are skipped."""
    return with_total(df, keys, value, "__total").select(
        *[c for c in df.columns if c != value],
        (safe_div(F.col(value), F.col("__total")) * F.lit(float(scale))).alias(value),
    )


def scenario_pair(df: DataFrame, scenario: str = SCENARIO) -> tuple[str, str]:
    """The two scenarios of a frame, in name order. Anything but two is an error."""
    rows = df.select(scenario).distinct().limit(3).collect()
    return check_pair(sorted(r[0] for r in rows))


def check_pair(scenarios: Sequence[str]) -> tuple[str, str]:
    if len(scenarios) != 2:
        raise ValueError("a scenario difference needs exactly two scenarios")
    return scenarios[0], scenarios[1]


def scenario_diff(
    df: DataFrame,
    scenarios: Sequence[str] | None = None,
    *,
    keys: Sequence[str] = ("Year", "Region"),
    scenario: str = SCENARIO,
    value: str = VALUE,
) -> DataFrame:
    """CMP-5: first-listed scenario minus the second, per key; NULL where one has no value.

    ``scenarios`` in registry order; without it the frame must hold exactly two.
    """
    a, b = scenario_pair(df, scenario) if scenarios is None else check_pair(list(scenarios))
    of = lambda name: F.avg(F.when(F.col(scenario) == F.lit(name), F.col(value)))
    return (
        df.filter(F.col(scenario).isin(a, b))
        .groupBy(*keys)
        .agg((of(a) - of(b)).alias(value))
        .withColumn(scenario, F.lit(DIFFERENCE_LABEL))
    )


def net(
    df_a: DataFrame, df_b: DataFrame, keys: Sequence[str], value: str = VALUE
) -> DataFrame:
    """CMP-6: ``df_a`` minus ``df_b`` per key as one signed union; a missing side counts as 0."""
    columns = [*keys, value]
    minus = df_b.select(*keys, (-F.col(value)).alias(value))
    return agg_sum(df_a.select(*columns).unionByName(minus), keys, value)

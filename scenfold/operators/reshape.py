"""Reshaping (RSH-*): long to wide as the last step, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenfold.model import SCENARIO, VALUE, YEAR
from scenfold.operators.aggregates import total
from scenfold.sources.storage import cut

def pivot_values(df: DataFrame, col: str) -> list[str]:
    """The sorted labels of a pivot column, from a job.

    Spark's own setting ``spark.sql.pivotMaxValues`` says how many columns such a pivot may have.
    """
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{col} has more labels than spark.sql.pivotMaxValues ({most})")
    return sorted(r[0] for r in rows)


def pivot_sum(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    values: Sequence[str] | None = None,
    value: str = VALUE,
) -> DataFrame:
    """RSH-1: one column per label, summed. An absent cell is NULL, an all-missing one 0."""
    values = pivot_values(df, col) if values is None else list(values)
    return df.groupBy(*keys).pivot(col, values).agg(total(value))


def pivot_mean(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    values: Sequence[str] | None = None,
    value: str = VALUE,
) -> DataFrame:
    """RSH-2: one column per label, averaged. An all-missing label stays as a NULL column."""
    values = pivot_values(df, col) if values is None else list(values)
    return df.groupBy(*keys).pivot(col, values).agg(F.avg(value))


def widened(
    df: DataFrame, wide: bool, col: str, values: Sequence[str] | None = None,
    keys: Sequence[str] = (SCENARIO, YEAR),
) -> DataFrame:
    """The last step of an analysis: one column per label of ``col`` if ``wide``, else as it is."""
    return pivot_sum(df, keys, col, values) if wide else df


def auto_pivot_column(df: DataFrame, candidates: Sequence[str] = ("e", "G", "R")) -> str | None:
    """RSH-3: the first candidate present with more than one label.

    One aggregate answers it for all candidates: a column has several labels when its smallest
    and largest differ, which needs no distinct count.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in present]).first()
    return next((c for c in present if row[c]), None)


def pivot_auto(
    df: DataFrame,
    keys: Sequence[str],
    candidates: Sequence[str] = ("e", "G", "R"),
    values: Sequence[str] | None = None,
    value: str = VALUE,
) -> DataFrame:
    """RSH-3: pivot on the automatically chosen column, or return the frame when none varies.

    The choice reads the frame, so it is computed once and checkpointed; it is an aggregate.
    """
    df = cut(df)
    col = auto_pivot_column(df, candidates)
    return df if col is None else pivot_sum(df, keys, col, values, value)


def melt(
    df: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str],
    var: str = "variable",
    value: str = VALUE,
) -> DataFrame:
    """RSH-4: wide to long. Missing cells stay as NULL rows."""
    return df.unpivot(list(ids), list(cols), var, value)

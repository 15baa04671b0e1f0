"""Projections (PRJ-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenfold.functions.literals import literal_frame, mapping_frame
from scenfold.model import VALUE


def drop(df: DataFrame, *cols: str) -> DataFrame:
    """PRJ-1."""
    return df.drop(*cols)


def relabel(
    df: DataFrame, col: str, mapping: Mapping[str, str], *, keep_unmatched: bool = True
) -> DataFrame:
    """PRJ-2: replace labels through a broadcast join on a literal mapping.

    ``keep_unmatched=False`` drops labels that are not in the map (inner join).
    """
    names = F.broadcast(mapping_frame(df.sparkSession, mapping, col, "__label"))
    if not keep_unmatched:
        return df.join(names, col).withColumn(col, F.col("__label")).drop("__label")
    return (
        df.join(names, col, "left")
        .withColumn(col, F.coalesce("__label", col))
        .drop("__label")
    )


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ-2 on column names, for frames that are already wide."""
    return df.withColumnsRenamed(dict(mapping))


def tag(df: DataFrame, col: str, literal: str) -> DataFrame:
    """PRJ-3: constant label column."""
    return df.withColumn(col, F.lit(literal))


def order(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """PRJ-4: keys, then series columns in a fixed order; an absent series is a NULL column."""
    present = set(df.columns)
    return df.select(
        *keys,
        *[
            F.col(f"`{name}`") if name in present else F.lit(None).cast("double").alias(name)
            for name in labels
        ],
    )


def split(
    df: DataFrame, col: str, bridge: Mapping[str, Mapping[str, float]], value: str = VALUE
) -> DataFrame:
    """SCA-10: distribute the rows of some labels over others by fixed weights.

    ``bridge`` maps a label to ``{target label: weight}``. Labels outside it pass unchanged. The
    result may hold several rows per target label; sum them at the analysis grain.
    """
    rows = [(src, dst, w) for src, parts in bridge.items() for dst, w in parts.items()]
    weights = literal_frame(df.sparkSession, f"{col} string, __to string, __weight double", rows)
    return (
        df.join(F.broadcast(weights), col, "left")
        .withColumn(value, F.col(value) * F.coalesce("__weight", F.lit(1.0)))
        .withColumn(col, F.coalesce("__to", col))
        .drop("__to", "__weight")
    )

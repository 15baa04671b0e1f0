"""Small driver-held tables as local relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW_TYPES = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def literal_frame(spark: SparkSession, schema: str, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """Rows held by the driver as a DataFrame.

    Going through Arrow gives a local relation with known size instead of a parallelized RDD, so
    Catalyst can fold and broadcast it without a job.
    """
    fields = [part.split() for part in schema.split(",")]
    columns = [
        pa.array([row[i] for row in rows], type=_ARROW_TYPES[kind])
        for i, (_, kind) in enumerate(fields)
    ]
    return spark.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))


def mapping_frame(
    spark: SparkSession, mapping: Mapping[str, Any], key: str, value: str, kind: str = "string"
) -> DataFrame:
    """A dict as a two-column literal DataFrame."""
    return literal_frame(spark, f"{key} string, {value} {kind}", list(mapping.items()))

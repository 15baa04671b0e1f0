"""What the text operators share: words, keys and tables kept between jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenfold.sources.storage import checkpoint_dir

# The white space that ends a word, for Java's and Python's regular expressions.
SPACES = "[ \\t-\\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Rows of a key that is never hot, and the most hot keys there can be (see ``spread_join``).
FEW = 10_000
HOT_KEYS = 10_000
LOWER_TABLE = str.maketrans(UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back.

    For tables that several jobs read: a lost executor costs a read, not a recomputation, and
    later jobs read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, totals: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Rows with the columns that ``totals`` holds for their key; rows of other keys go.

    ``totals``, a stored table, has one row per key, and in ``count`` how many rows have it. Keys of more than
    ``FEW`` rows and more than a ``HOT_KEYS``-th of all rows are hot. As counts add up to the number of
    rows, there are at most ``HOT_KEYS`` of them at any size: they are broadcast, and their rows
    stay where they are. All others are joined by a shuffle in which no key is large. ``rows`` are
    read twice if there is a hot key. A null key has no match.
    """
    seen = totals.agg(F.sum(count), F.max(count)).first()
    limit = max(FEW, (seen[0] or 0) // HOT_KEYS)
    if (seen[1] or 0) <= limit:
        return rows.join(totals.drop(count), key)
    hot = totals.filter(F.col(count) > limit).drop(count)
    rest = totals.filter(F.col(count) <= limit).drop(count)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))


def content(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of anything but white space, as an array; empty for a null text."""
    return F.array_remove(F.split(content(text), SPACES), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_value(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    The value becomes a lambda variable; a plain column would be computed again by every element
    of a higher-order function that refers to it.
    """
    return F.transform(F.array(value), lambda x: use(x))[0]


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 5

"""Hot keys, and lexicons larger than a constant table."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from scenfold.llm import common, components, imatch, simhash
from scenfold.llm.common import documents as read_documents

from .frames import documents

SF_DIR = "/root/testdata/sf0.001"


def pieces(df):
    return [n for (n,) in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


@pytest.mark.parametrize("few", [10, 100_000])
def test_spread_join_is_a_join(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rows = spark.createDataFrame(
        [(0, i) for i in range(500)] + [(1, i) for i in range(3)] + [(None, 7), (9, 8)], "k long, v long"
    )
    totals = spark.createDataFrame([(0, "a", 500), (1, "b", 3), (2, "c", 0), (None, "d", 1)], "k long, name string, n long")
    found = common.spread_join(rows, common.stored(totals), "k").collect()
    expected = [(0, i, "a") for i in range(500)] + [(1, i, "b") for i in range(3)]
    assert sorted((r.k, r.v, r.name) for r in found) == expected
    assert common.spread_join(rows.limit(0), totals.limit(0), "k").collect() == []


def test_a_star_is_not_one_task(spark):
    """A node with all of 10^6 links: its minimum goes to its links, wherever they are."""
    links = common.stored(spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).repartition(16))
    least = common.stored(links.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")))
    rows = pieces(common.spread_join(links, least, "u"))
    assert sum(rows) == 1_000_000
    assert max(rows) <= 3 * median(rows)
    found = components.components(links).agg(F.count("*"), F.max("component")).first()
    assert tuple(found) == (1_000_001, 0)


def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    docs = read_documents(spark, SF_DIR)
    plain = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    dropped = sorted(tuple(r) for r in simhash.duplicate_ids(docs).collect())
    monkeypatch.setattr(common, "FEW", 1)
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs, bucket=8).collect()) == plain
    assert sorted(tuple(r) for r in simhash.duplicate_ids(docs, bucket=8).collect()) == dropped


@pytest.mark.parametrize("few", [10, 10_000])
def test_joined_lexicon_gives_the_tables_fingerprints(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    docs = read_documents(spark, SF_DIR).unionByName(documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    plain = [tuple(r) for r in imatch.edited(docs).collect()]
    joined = [tuple(r) for r in imatch.edited(docs, max_table=0).collect()]
    assert sorted(joined, key=repr) == sorted(plain, key=repr)


def test_a_lexicon_beyond_the_table(spark):
    """120,000 terms of one document each: no cap, and near copies are told as such."""
    texts = [(i, " ".join(f"t{i}x{j}" for j in range(1200))) for i in range(100)]
    docs = spark.createDataFrame([*texts, (100, texts[0][1])], "doc_id long, text string")
    band = imatch.lexicon(docs, rare=1000).filter("banded")
    assert band.count() == 120_000 > imatch.MAX_LEXICON
    found = {r.doc_id: r for r in imatch.edited(docs, rare=1000).collect()}
    assert len(found) == 101
    assert found[0].parts == found[100].parts
    assert found[0].near_next < 0.2


def test_equal_ids_are_spread(spark):
    docs = spark.createDataFrame(
        [(None if i % 3 else i, f"text {i}") for i in range(3000)], "doc_id long, text string"
    )
    rows = imatch.with_successors(docs, [], slice_docs=50)
    found = rows.select("text", "next_text").collect()
    order = sorted(
        docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(),
        key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.h),
    )
    assert {r.text: r.next_text for r in found} == {
        a.text: b.text for a, b in zip(order, order[1:] + order[:1], strict=True)
    }

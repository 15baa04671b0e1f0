"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from scenfold.llm import (
    classifier, coder, hmm, imatch, merkle, mixing, packing, phrases, rules, secrets, sharding, simhash,
)
from scenfold.llm.tokens import public_path

from .frames import ROWS, documents


def labels(spark, rows=((0, 1), (2, 1), (6, 1), (7, 0), (10, 0), (10, 0), (99, 1), (4, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def coded(docs, folder):
    path = f"file://{folder}/blocks"
    coder.write_blocks(docs, path, public_path("word_bpe_49k.json"), end_id=2)
    return coder.read_blocks(docs.sparkSession, path)


OPERATORS = {
    "simhash": lambda docs, tmp: simhash.near_duplicates(docs),
    "deduplicated": lambda docs, tmp: simhash.deduplicated(docs),
    "rules": lambda docs, tmp: rules.judged(
        docs, labels(docs.sparkSession).select(F.col("doc_id").alias("trusted_id")), buckets=1024
    ),
    "packing": lambda docs, tmp: packing.packed(docs, public_path("byte_bpe_50k.json")),
    "coder": coded,
    "hmm": lambda docs, tmp: hmm.scored(docs, iterations=1),
    "secrets": lambda docs, tmp: secrets.scanned(docs),
    "redaction": lambda docs, tmp: secrets.without_secrets(docs),
    "imatch": lambda docs, tmp: imatch.edited(docs),
    "sharding": lambda docs, tmp: sharding.place(docs, "doc_id", {"shard": sharding.filled_table(["a", "b"], 101)}),
    "classifier": lambda docs, tmp: classifier.classified(
        docs, classifier.trained(docs, labels(docs.sparkSession))
    ),
    "good_documents": lambda docs, tmp: classifier.good_documents(
        docs, classifier.trained(docs, labels(docs.sparkSession))
    ),
    "mixing": lambda docs, tmp: mixing.mix(docs),
    "merkle": lambda docs, tmp: merkle.proven(merkle.manifest(docs, merkle.with_added_chars())),
    "phrases": lambda docs, tmp: phrases.collocations(docs, min_count=2),
    "mixed_documents": lambda docs, tmp: mixing.mixed_documents(docs),
}
#: Rows out for ROWS, where every row is kept.
WHOLE = ("simhash", "rules", "coder", "hmm", "secrets", "redaction", "imatch", "sharding", "classifier", "merkle", "mixing")


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, tmp_path, name):
    found = OPERATORS[name](documents(spark), tmp_path).collect()
    assert found
    if name in WHOLE:
        assert len(found) == len(ROWS)
        ids = sorted((r["doc_id"] for r in found), key=repr)
        assert ids == sorted((r[0] for r in ROWS), key=repr)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(spark, tmp_path, name):
    docs = documents(spark)
    found = OPERATORS[name](docs.limit(0), tmp_path)
    assert found.collect() == []
    if name in ("deduplicated", "redaction", "good_documents", "mixed_documents"):
        assert found.columns == docs.columns

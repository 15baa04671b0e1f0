"""The registered queries of this subpackage, one per operator, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenfold.sources.storage import checkpoint_dir

from . import (
    classifier, coder, hmm, imatch, merkle, mixing, neighbours, packing, phrases, rules, secrets,
    sharding, simhash,
)
from .common import documents, embeddings, labels
from .tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op2_quality_rules(spark, sf_dir):
    good = labels(spark, sf_dir).filter("quality = 1").select(F.col("doc_id").alias("trusted_id"))
    return rules.judged(documents(spark, sf_dir), good)


@query
def op3_packing(spark, sf_dir):
    digest = {"ids_crc32": F.crc32("ids")}
    return packing.packed(
        documents(spark, sf_dir), public_path("byte_bpe_50k.json"), digest
    ).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op4_token_coder(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    coder.write_blocks(documents(spark, sf_dir), path, public_path("word_bpe_49k.json"), end_id=2)
    return coder.read_blocks(spark, path, {"ids_crc32": F.crc32("ids")})


@query
def op5_language_model(spark, sf_dir):
    return hmm.scored(documents(spark, sf_dir))


@query
def op6_secrets(spark, sf_dir):
    return secrets.scanned(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans",
    )


@query
def op7_imatch(spark, sf_dir):
    def joined(parts: str):
        return F.concat_ws("", parts)

    return imatch.edited(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        joined("parts").alias("fingerprint"), joined("edited_parts").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query
def op8_sharding(spark, sf_dir):
    """The shard of every document, and where it would be with one shard more."""
    names = sharding.shard_names()
    grown = sharding.shard_names(len(names) + 1)
    tables = {"shard": sharding.filled_table(names), "shard_grown": sharding.filled_table(grown)}
    docs = documents(spark, sf_dir).select("doc_id")
    return sharding.place(docs, "doc_id", tables).select("doc_id", "slot", "shard", "shard_grown")


@query
def op9_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return classifier.classified(docs, classifier.trained(docs, labels(spark, sf_dir)))


@query
def op10_mixing(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "position",
    )


@query
def op12_merkle(spark, sf_dir):
    """The manifest of all documents, with one in seven tampered with before its proof is checked."""
    return merkle.proven(merkle.manifest(documents(spark, sf_dir), merkle.with_added_chars()))


@query
def op13_collocations(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


@query
def op11_neighbours(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    return neighbours.nearest(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0)

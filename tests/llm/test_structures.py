"""Nearest neighbours, hash trees and phrase counts against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenfold.llm import merkle, neighbours, phrases
from scenfold.llm.common import documents as read_documents
from scenfold.llm.queries import QUERIES

from .frames import documents

SF_DIR = "/root/testdata/sf0.001"


# --- Nearest neighbours ------------------------------------------------------------------------


def brute_neighbours(rows, is_query, k):
    """Of (id, vector) rows, which are distinct."""
    out = {}
    for q, v in rows:
        if is_query(q):
            near = sorted(
                (float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), i)
                for i, w in rows if (i, w) != (q, v) and len(w) == len(v)
            )
            out.setdefault(q, []).extend(near[:k])
    return out


def found_neighbours(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return dict(out)


def test_neighbours_of_the_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = [(r["vec_id"], tuple(r["embedding"])) for r in rows]
    expected = brute_neighbours(rows, lambda q: q % 100 == 0, 10)
    found = found_neighbours(QUERIES["op11_neighbours"](spark, SF_DIR))
    assert found.keys() == expected.keys()
    same = sum(x in [y[1] for y in expected[q]] for q in found for _, x in found[q])
    assert same >= 0.9 * sum(map(len, expected.values()))
    exact = dict(rows)
    for q, near in found.items():
        for score, x in near:
            assert score == pytest.approx(np.linalg.norm(np.array(exact[q]) - np.array(exact[x])), abs=1e-12)


@pytest.mark.parametrize("clusters", [1, 12])
def test_many_blocks_keep_the_recall(spark, clusters):
    """Blocks of 50 vectors; without clusters no block can be left out, with them most are."""
    draw = np.random.default_rng(clusters)
    centres = draw.normal(size=(clusters, 24)) * (4 if clusters > 1 else 0)
    vectors = centres[draw.integers(0, clusters, 1500)] + draw.normal(size=(1500, 24))
    rows = [(i, tuple(map(float, v))) for i, v in enumerate(vectors)]
    rows += [(2000 + i, rows[7][1]) for i in range(700)]  # a third are one vector
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    is_query = F.col("vec_id") % 50 == 0
    found = found_neighbours(neighbours.nearest(table, is_query, block=50, queries=8))
    expected = brute_neighbours(rows, lambda q: q % 50 == 0, 10)
    assert found.keys() == expected.keys()
    assert all(len(near) == 10 for near in found.values())
    hits = sum(len({x for _, x in found[q]} & {x for _, x in expected[q]}) for q in expected)
    assert hits >= 0.97 * 10 * len(expected)
    for q in (2000, 2100):  # ties go to the smallest ids
        assert [x for _, x in found[q]] == [x for _, x in expected[q]]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (0, [5.0, 5.0]),
        (100, [2.0, 2.0, 2.0]),
    ]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, dim int")
    is_query = F.col("vec_id") % 100 == 0
    found = [tuple(r) for r in neighbours.nearest(table, is_query).orderBy("query_id", "score", "vec_id").collect()]
    first = [(0, 9, 0.0), (0, 1, 1.0), (0, 0, 41**0.5)]
    second = [(0, 1, 32**0.5), (0, 0, 41**0.5), (0, 9, 41**0.5)]
    assert sorted((q, x, s) for q, _, x, s in found if q == 0) == sorted(first + second)
    assert [(q, x, s) for q, _, x, s in found if q == 100] == [(100, 8, 3.0)]
    assert neighbours.nearest(table.limit(0), is_query).collect() == []
    assert neighbours.nearest(table.filter("vec_id = 8"), is_query).collect() == []
    alone = neighbours.nearest(table.filter("vec_id = 100"), is_query)
    assert alone.collect() == []


# --- Hash trees --------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, added=0):
    def field(value):
        text = None if value is None else str(value)
        return "-" if text is None else f"{len(text.encode())}:{text}"

    n = None if r["n_chars"] is None else r["n_chars"] + added
    return digest(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def plain_tree(hashes):
    """The root, and each node's steps to it, as (before, after)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(at):
            other = hashes[p ^ 1] if p ^ 1 < len(hashes) else ""
            paths[i].append((other, "") if p & 1 else ("", other))
            at[i] = p >> 1
        hashes = [digest(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)]
    return hashes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in names])
    for g, top in zip(names, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = plain_leaf(r, int(hit))
            for before, after in path + top:
                h = digest(before, h, after)
            proof = digest(*[a + b for a, b in path + top])
            yield r["doc_id"], plain_leaf(r), trees[g][0], root, proof, h, h == root


def manifest(docs):
    return sorted(map(tuple, merkle.proven(merkle.manifest(docs, merkle.with_added_chars())).collect()), key=repr)


@pytest.mark.parametrize("bits, digits", [(4, 3), (1, 2), (2, 1)])
def test_manifest_of_blocks_in_blocks(spark, monkeypatch, bits, digits):
    """Blocks of four leaves need rollups of rollups; the trees are the same."""
    monkeypatch.setattr(merkle, "BASE_BITS", bits)
    monkeypatch.setattr(merkle, "BASE", 1 << bits)
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits * digits)
    docs = read_documents(spark, SF_DIR).filter("doc_id < 75")
    found = manifest(docs)
    assert found == sorted(plain_manifest(docs.collect()), key=repr)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_odd_rows(spark):
    docs = documents(spark)
    assert manifest(docs) == sorted(plain_manifest(docs.collect()), key=repr)
    one = docs.filter("doc_id = 0")
    assert manifest(one) == list(plain_manifest(one.collect()))
    assert manifest(docs.limit(0)) == []


# --- Phrases -----------------------------------------------------------------------------------


def plain_counts(texts, width):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(table)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            counts.update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return counts


@pytest.mark.parametrize("burst, held", [(16, 200), (1 << 16, 1 << 21)])
def test_tries_that_burst_and_spill_count_alike(burst, held):
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "A"]
    texts = [" ".join(draw.choice(words, 40)) + ". tail\tend;x" for _ in range(60)]
    for width in (1, 2, 3):
        counter = phrases.Counter("en", width, np.full(phrases.FILTER_BITS // 8, 255, np.uint8), held, burst)
        runs, found = 0, Counter()
        batches = [b for i in range(0, 60, 7) for b in counter.read(texts[i : i + 7])] + list(counter.runs(0))
        for batch in batches:
            listed = batch["phrase"].to_pylist()
            assert listed == sorted(listed, key=str.encode)
            runs += 1
            for phrase, f in zip(listed, batch["f"].to_pylist(), strict=True):
                found[tuple(phrase.split(" "))] += f
        assert found == plain_counts(texts, width)
        assert runs > 1 or held > 1000
        assert not counter.trie.held


def test_equal_hashes_do_not_merge_sequences():
    box = phrases.Container(2)
    ids = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [1, 2]], np.int32)
    box.add(np.full(5, 9, np.uint64), ids, np.ones(5, np.int64))
    box.take_up()
    assert sorted(zip(map(tuple, box.ids.tolist()), box.counts.tolist(), strict=True)) == [((1, 2), 3), ((3, 4), 2)]


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**12, 9 * 10**12, 10**12 + 7, 10**12 + 9), (100, 2 * 10**13, 101, 103), (3, 7, 1, 2)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    found = df.select(phrases.floor_ratio(*[F.col(c) for c in "anlr"])).collect()
    assert [r[0] for r in found] == [1000 * a * n // (x * y) for a, n, x, y in cases]


def test_phrases_of_odd_rows(spark):
    rows = phrases.collocations(documents(spark), min_count=2).collect()
    assert {r["lang"] for r in rows} <= {"en", "de"}
    same = next(r for r in rows if r["phrase"] == "same same same same same")
    assert (same["a"], same["l"], same["r"]) == (116, 120, 117)
    unnamed = documents(spark, [(i, "Big apple, BIG APPLE", None, "a") for i in range(3)])
    assert [tuple(r) for r in phrases.collocations(unnamed, min_count=3).collect()] == [
        ("und", 1, "big apple", 6, 6, 6, 12, 2000)
    ]

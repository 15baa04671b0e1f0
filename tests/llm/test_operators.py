"""The operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scenfold.llm import (
    classifier, coder, components, golay, hmm, mixing, packing, rules, secrets, sharding, simhash, tokens,
)
from scenfold.llm.common import documents as read_documents
from scenfold.llm.common import labels as read_labels
from scenfold.llm.queries import QUERIES

from .frames import documents

SF_DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def rows(spark):
    return read_documents(spark, SF_DIR).orderBy("doc_id").collect()


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


# --- SimHash -----------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_simhash_matches_brute_force(spark, rows):
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    links = [
        (a, b) for a in prints for b in prints
        if a < b and (prints[a] ^ prints[b]).bit_count() <= 2
    ]
    expected = plain_components(links, prints)
    found = QUERIES["op1_simhash"](spark, SF_DIR).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in found} == {
        i: (p, expected[i]) for i, p in prints.items()
    }


@pytest.mark.parametrize("keys, radius", [(golay.keys_within_2, 2), (golay.keys_within_5, 5)])
def test_close_vectors_share_a_golay_key(keys, radius):
    draw = random.Random(3)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a ^ sum(1 << i for i in draw.sample(range(64), radius))
        row, key = keys(np.array([a, b], np.uint64))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_golay_decoding_finds_the_nearest_word():
    assert len({int(w) for w in golay.decoded(np.arange(1 << 12, dtype=np.int32) << 11)}) <= 4096
    words = [m << 11 | golay.remainder(m << 11) for m in (0, 1, 77, 4095)]
    for m, word in zip((0, 1, 77, 4095), words, strict=True):
        assert golay.remainder(word) == 0
        flipped = np.array([word, word ^ 1, word ^ 0b11 << 20, word ^ 1 << 22 ^ 1 << 11 ^ 1], np.int32)
        assert golay.decoded(flipped).tolist() == [m] * 4


def test_large_buckets_are_dealt_in_blocks(spark):
    """Five hundred fingerprints in a chain of single differences, with buckets of at most 8."""
    prints, at = [], 0
    for i in range(500):
        at ^= 1 << (i * 7 % 11)  # all within a few low bits, so in common buckets
        prints.append(at)
    unique = sorted(set(prints))
    frame = spark.createDataFrame([(p, p) for p in unique], "node long, search long").withColumn(
        "print", F.unhex(F.lpad(F.hex("node"), 16, "0"))
    )
    links = simhash.linked(frame, golay.keys_within_2, 2, 1, bucket=8)
    found = {r.node: r.component for r in components.components(links).collect()}
    near = [(a, b) for a in unique for b in unique if a < b and (a ^ b).bit_count() <= 2]
    assert found == plain_components(near, unique)


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 999), (998, 999), (5, 5)]
    edges = spark.createDataFrame(chain, "u long, v long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 998: 998, 999: 998, 1000: 998}


def test_deduplication_keeps_one_of_each_group(spark):
    base = [f"w{i}" for i in range(300)]
    draw = random.Random(5)

    def near():
        copy = list(base)
        for i in draw.sample(range(300), 3):
            copy[i] = f"x{draw.random()}"
        return " ".join(copy)

    texts = [" ".join(base), " ".join(base), near(), near()]
    texts += [" ".join(f"d{k}.{i}" for i in range(300)) for k in range(5)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = [r.doc_id for r in simhash.deduplicated(docs).select("doc_id").collect()]
    assert sorted(kept) == [0, 4, 5, 6, 7, 8]


def test_documents_without_an_id_take_part_in_deduplication(spark):
    base = [f"w{i}" for i in range(300)]
    near, link = base[:150] + ["new"] + base[151:], base[:295]
    far = [f"w{i}" for i in range(36, 295)]  # alike to the link at 0.8 or more, to the whole less
    alone = [f"d{i}" for i in range(300)]
    rows = [(None, " ".join(t), "en", "a") for t in (base, base, near, link, alone, alone, alone[:-1], ["x"])]
    rows += [(7, " ".join(base), "en", "a"), (9, " ".join(far), "en", "a"), (8, "y", "en", "a"), (None, None, "en", "a"), (None, "", "de", "b")]
    docs = documents(spark, rows).repartition(4)
    found = simhash.deduplicated(docs)
    assert found.columns == docs.columns
    kept = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "").split()[:1]) for r in found.collect())
    assert kept == [(-1, []), (-1, ["d0"]), (-1, ["x"]), (7, ["w0"]), (8, ["y"])]
    assert [tuple(r) for r in simhash.duplicate_ids(docs).collect()] == [(9, 7)]


def edited_pair(draw, words, kind):
    """Two texts with a five-word-shingle similarity of 0.8 or barely more, and that similarity."""
    text = [f"w{int(draw.paretovariate(0.4))}.{draw.randrange(9)}" for _ in range(words)]
    new, copy, best = [f"n{draw.random()}" for _ in range(words)], text, None
    where = draw.sample(range(words), words)
    for n in range(1, words, max(1, words // 100)):
        if kind == "appended":
            copy = text + new[:n]
        elif kind == "cut":
            copy = text[n:]
        elif kind == "inserted":
            copy = text[: words // 2] + new[:n] + text[words // 2 :]
        else:
            copy = [new[i] if i in set(where[:n]) else w for i, w in enumerate(text)]
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (text, copy))
        if 5 * len(a & b) < 4 * len(a | b):
            break
        best = (" ".join(text), " ".join(copy), len(a & b) / len(a | b))
    return best


@pytest.mark.parametrize("kind", ["appended", "cut", "inserted", "substituted"])
def test_search_finds_pairs_at_the_limit(kind):
    draw = random.Random(kind)
    for words in [60, 100, 300, 1000] * 15:
        a, b, like = edited_pair(draw, words, kind)
        assert 0.8 <= like < 0.96
        (left, _), (right, _) = (simhash.sketch(simhash.shingle_set(t)) for t in (a, b))
        assert (np.frombuffer(left, np.uint64) == np.frombuffer(right, np.uint64)).any()


def test_only_the_shingle_sets_decide(spark):
    base = [f"w{i}" for i in range(300)]
    line = [f"l{i}" for i in range(20)]
    short = [f"s{i}" for i in range(10)]
    texts = [
        base,
        base + line * 10,  # 44 more distinct shingles
        *([*base[:i], "x", *base[i + 1 :]] for i in (3, 150)),
        [f"c{i}" for i in range(300)],
        [f"c{i}" for i in range(300)] + [f"y{i}" for i in range(90)],  # 0.77
        short, [*short[:-1], "z"],  # 5 of 7
        [f"d{i}" for i in range(100)], [f"d{i}" for i in range(100)] + [f"e{i}" for i in range(24)],  # 0.8
    ]
    docs = documents(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)])
    kept = [r.doc_id for r in simhash.deduplicated(docs).select("doc_id").collect()]
    assert sorted(kept) == [0, 4, 5, 6, 7, 8]


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """A chain of texts, each 0.82 or so like the one after it, with blocks of a few texts."""
    monkeypatch.setattr(simhash, "SHINGLES", 400)
    texts = [" ".join(f"w{i}" for i in range(k * 10, k * 10 + 104)) for k in range(40)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    assert {tuple(r) for r in simhash.duplicate_ids(docs).collect()} == {(i, 0) for i in range(1, 40)}


def test_candidate_links_are_decided_by_their_sets(spark, monkeypatch):
    """The search's candidate links are each kept only where their two sets are 0.8 alike or more."""
    base = [f"d{i}" for i in range(100)]
    texts = [base, base + [f"e{i}" for i in range(24)], base + [f"e{i}" for i in range(30)]]  # 0.8, 0.76; 0.95
    sets = [simhash.shingle_set(" ".join(t)) for t in texts]
    names = [simhash.set_name(x) for x in sets]
    made = spark.createDataFrame([(n, x.tobytes()) for n, x in zip(names, sets)], "node long, shingles binary")
    pairs = spark.createDataFrame([(names[0], names[1]), (names[0], names[2])], "u long, v long")
    assert {tuple(r) for r in simhash.checked(made, pairs).collect()} == {(names[0], names[1])}
    seen, checked = [], simhash.checked
    monkeypatch.setattr(simhash, "checked", lambda m, c: seen.append(c.count()) or checked(m, c))
    docs = documents(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)])
    assert sorted(tuple(r) for r in simhash.duplicate_ids(docs).collect()) == [(1, 0), (2, 0)]
    assert seen and seen[0] >= 1


@pytest.mark.parametrize("sizes", [(60, 1), (40, 25, 1, 1), (12, 11, 10, 9, 8), (70,)])
def test_sets_outside_the_largest_piece_meet_all(spark, monkeypatch, sizes):
    """One large component of candidates, in truth several groups: near copies of a text each, and a bridge."""
    monkeypatch.setattr(simhash, "SHINGLES", 600)
    draw, texts = random.Random(7), []
    for group, n in enumerate(sizes):
        base = [f"g{group}.{i}" for i in range(100)]
        for k in range(n):
            at = 2 + draw.randrange(96)
            texts.append(" ".join([*base[:at], f"x{group}.{k}", *base[at + 1 :]]))
    texts += [texts[0] + " " + " ".join(f"y{i}" for i in range(n)) for n in (12, 24, 36)]  # a chain
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    sets = [simhash.shingle_set(t) for t in texts]
    names = [simhash.set_name(x) for x in sets]
    rows = [(names[i], 1, len(sets[i]), i) for i in range(len(texts))]
    groups = spark.createDataFrame(rows, "node long, component long, size long, least_id long")
    pairs = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if 5 * len(shared := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(shared))
    ]
    expected = spark.createDataFrame([(names[i], names[j]) for i, j in pairs], "u long, v long")
    met = []
    outsiders = simhash.outsiders

    def counted(large, pieces):
        met.append((large.count(), outsiders(large, pieces).count()))
        return outsiders(large, pieces)

    monkeypatch.setattr(simhash, "outsiders", counted)
    found = {tuple(r) for r in components.components(simhash.similar(docs, groups)).collect()}
    assert found == {tuple(r) for r in components.components(expected).collect()}
    blocks = sum(len(x) for x in sets) // 600 + 1
    if sizes in ((60, 1), (70,)):  # few outsiders: every set meets about once, not every block
        assert met[0][1] <= 2 * met[0][0] + 8 * blocks


# --- Rules -------------------------------------------------------------------------------------


def plain_counts(text):
    words = split(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)
    )


def test_base_counts_match_brute_force(spark, rows):
    texts = [(r.doc_id, r.text) for r in rows] + [
        (-1, None), (-2, ""), (-3, "a b c"), (-4, "a a a a"), (-5, "a b c a b c"), (-6, "x\nx\n \n \nx"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    names = list(rules.base_counts(F.col("text")))
    found = docs.select("doc_id", *[c.alias(n) for n, c in rules.base_counts(F.col("text")).items()])
    assert {r.doc_id: tuple(r[n] for n in names) for r in found.collect()} == {
        i: plain_counts(t) for i, t in texts
    }


def test_ratio_prefers_trusted_words(spark):
    good = [(i, " ".join(f"good{(i + k) % 30}" for k in range(100))) for i in range(20)]
    bad = [(100 + i, " ".join(f"bad{(i + k) % 30}" for k in range(100))) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(10)], "trusted_id long")
    found = rules.judged(docs, trusted, buckets=4096, smoothing=0.01).collect()
    assert all((r.log_ratio > 0.3) == (r.doc_id < 100) for r in found)
    assert all(r.kept == (not r.base_failed and r.doc_id < 100) for r in found)


def test_log_ratio_is_the_mean_over_ngrams(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b b c")], "doc_id long, text string")
    trusted = spark.createDataFrame([(0,)], "trusted_id long")
    grams = {0: ["a", "b", "a", "a b", "b a"], 1: ["b", "b", "c", "b b", "b c"]}
    raw, good = Counter(grams[0] + grams[1]), Counter(grams[0])
    spread = rules.BUCKETS
    for r in rules.judged(docs, trusted).collect():
        ratio = [
            math.log((good[g] + 1) / (5 + spread) / ((raw[g] + 1) / (10 + spread)))
            for g in grams[r.doc_id]
        ]
        assert r.log_ratio == pytest.approx(sum(ratio) / 5, abs=1e-5)


# --- Packing -----------------------------------------------------------------------------------


def test_packed_pieces_are_whole_and_gapless(spark, rows):
    encoder = tokens.Encoder(tokens.public_path("byte_bpe_50k.json"), tokens.BYTE_LEVEL).tokenizer
    found = QUERIES["op3_packing"](spark, SF_DIR).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in rows:
        ids = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            piece = np.array(ids[at : at + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(piece.tobytes())
            at += p.length
        assert at == len(ids)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
        used += at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert used / (packing.CAPACITY * len(by_sequence)) > 0.97


def test_patterns_hold_the_histogram():
    draw = random.Random(1)
    histogram = {n: draw.randrange(1, 10**9) for n in draw.sample(range(1, 1025), 400)}
    patterns = packing.packing_patterns(histogram)
    held = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 1024
        for n in lengths:
            held[n] += count
    assert held == histogram
    assert len(patterns) < 3000


# --- Tokens and coder --------------------------------------------------------------------------


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cut_texts_have_the_tokenizers_ids(rows, name, kind):
    encoder = tokens.Encoder(tokens.public_path(name), kind)
    odd = [
        "", " ", "a  b", " x y ", "foo\n bar", "it's <|endoftext|>x", "a  b  c", "\tq \n",
        "é ́x", "x\0y z", "café, İstanbul. ΣΑΣ!", "a \n", "a!!! b?.",
        "one\ntwo\n\nthree.\nFour", "\nx\n", "x\n's\n\ty", "a\t\nb \nc\n d", "12\n34\n#5\n\x1c6",
    ]
    for text in [r.text for r in rows] + odd:
        plain = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        assert encoder.encode([text])[0] == plain.tobytes(), text[:50]


def test_block_round_trips():
    draw = np.random.default_rng(2)
    for ids in (
        np.zeros(0, int), np.array([65535]), np.zeros(5000, int), draw.integers(0, 65536, 3000),
        draw.zipf(1.2, 20_000) % 49_408, np.tile(draw.integers(0, 9999, 700), 40),
    ):
        assert (coder.decode_block(coder.encode_block(ids)) == ids).all()
    assert len(coder.encode_block(np.tile(draw.integers(0, 9999, 700), 40))) < 28_000


def test_a_block_of_documents_takes_less_than_its_order_0_entropy(spark):
    texts = [r.text or "" for r in read_documents(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()]
    encoder = tokens.Encoder(tokens.public_path("word_bpe_49k.json"), tokens.WORD_LEVEL)
    ids = np.frombuffer(b"".join(encoder.encode(texts)), "<u4")
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert 8 * len(coder.encode_block(ids)) < -(share * np.log2(share)).sum() * len(ids)


def test_every_id_has_a_part_of_the_interval_however_sure_the_predictions_are():
    model, lanes = coder.Model(), 64
    for step in range(3000):
        before, last = np.full(lanes, (step - 2) % 5), np.full(lanes, (step - 1) % 5)
        model.predict(before, last)
        model.interval(now := np.full(lanes, step % 5))
        model.update(now)
    for i in range(0, 1 << coder.ID_BITS, 4096):
        ids = np.arange(i, i + 4096)
        model.predict(np.full(4096, (step - 1) % 5), np.full(4096, step % 5))
        begin, size = model.interval(ids)
        assert (size > 0).all()
        assert (model.ids_in(begin) == ids).all() and (model.ids_in(begin + size - 1) == ids).all()
    assert model.chance.min() > 60_000


def test_a_surprise_after_a_long_repeat_round_trips():
    ids = np.tile(np.arange(5), 60_000)
    ids[200_000::7001] = 40_000
    assert (coder.decode_block(coder.encode_block(ids)) == ids).all()


def test_words_are_kept_in_few_bytes_and_encoded_as_when_they_are_not():
    texts = [" ".join(f"{a}{b}{c}{tail}" for b in "abcdefgh" for c in "pqrstuvw" for tail in ("", ".", "é,", "7"))
             for a in ("Wo", "no", "É", "x-")]
    encoder = tokens.Encoder(tokens.public_path("word_bpe_49k.json"), tokens.WORD_LEVEL)
    first = encoder.encode(texts)
    kept = encoder.words
    assert len(kept.words) == len({w for t in texts for w in t.split()})
    assert kept.words.nbytes + kept.ids.nbytes + kept.starts.nbytes < 60 * len(kept.words)
    assert first == encoder.encode(texts) == encoder.whole(texts)


def test_damaged_blocks_are_refused():
    block = coder.encode_block(np.arange(2000) % 50)
    for damaged in (block[:-1], block[:10], b"", block[:-9] + bytes([block[-9] ^ 1]) + block[-8:], b"x" + block[1:]):
        with pytest.raises(ValueError):
            coder.decode_block(damaged)
    with pytest.raises(ValueError):
        coder.encode_block(np.array([1 << 16]))


def test_token_files_read_back(spark, rows):
    encoder = tokens.Encoder(tokens.public_path("word_bpe_49k.json"), tokens.WORD_LEVEL).tokenizer
    found = {r.doc_id: r for r in QUERIES["op4_token_coder"](spark, SF_DIR).collect()}
    at = 0
    for r in rows:
        ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected = (at, len(ids), zlib.crc32(ids.tobytes()))
        assert (found[r.doc_id].start, found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == expected
        at += len(ids)


def test_small_blocks_keep_the_order(spark, tmp_path):
    docs = documents(spark)
    path = f"file://{tmp_path}/blocks"
    coder.write_blocks(docs, path, tokens.public_path("word_bpe_49k.json"), end_id=2, block=10)
    found = sorted(coder.read_blocks(spark, path).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids)
    at = 0
    for r in found:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens


# --- Language model ----------------------------------------------------------------------------


def test_language_model_scores(spark, rows):
    found = {r.doc_id: r for r in QUERIES["op5_language_model"](spark, SF_DIR).collect()}
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = found[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(t), n)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    gain = sum(r.score - r.base_score for r in found.values() if r.held_out)
    assert gain > 0.1 * sum(r.n_tokens for r in found.values() if r.held_out)


def small_model(draw):
    def rows_of(n, k):
        x = draw.random((n, k)) + 0.01
        return x / x.sum(1, keepdims=True)

    return hmm.Hmm(rows_of(1, 8)[0], rows_of(1, 8)[0], rows_of(8, 8), rows_of(8, hmm.SYMBOLS))


def test_forward_is_exact():
    draw = np.random.default_rng(4)
    model = small_model(draw)
    texts = [draw.integers(0, hmm.SYMBOLS, n) for n in (1, 2, 40, 256, 257, 258, 3000)]
    for text, found in zip(texts, hmm.log_likelihoods(model, texts), strict=True):
        now, log = model.start * model.emit[:, text[0]], 0.0
        for symbol in text[1:]:
            log += math.log10(now.sum())
            now = (now / now.sum()) @ model.move * model.emit[:, symbol]
        assert found == pytest.approx(log + math.log10(now.sum()), rel=1e-10)


def test_baum_welch_counts_and_gain():
    draw = np.random.default_rng(5)
    model = small_model(draw)
    texts = [draw.integers(0, 50, n) for n in (1, 2, 3, 17)]
    first = [True, False, True, True]
    starts, resumes, moves, emissions = hmm.expected_counts(model, texts, first)
    assert starts.sum() == pytest.approx(3) and resumes.sum() == pytest.approx(1)
    assert moves.sum() == pytest.approx(sum(len(t) - 1 for t in texts))
    seen = Counter(np.concatenate(texts).tolist())
    by_symbol = emissions.reshape(8, -1).sum(0)
    assert all(by_symbol[s] == pytest.approx(n) for s, n in seen.items())
    overall = np.full(hmm.SYMBOLS, 1e-12)
    before = hmm.log_likelihoods(model, [texts[3]])[0]
    for _ in range(3):
        sums = np.concatenate(hmm.expected_counts(model, [texts[3]], [True]))
        model = hmm.updated(model, sums, overall)
    assert hmm.log_likelihoods(model, [texts[3]])[0] > before


# --- Secrets -----------------------------------------------------------------------------------


def plain_secrets(text):
    assign = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [
        ("assign", *m.span()) for m in re.finditer(assign, text, re.ASCII) if len(m[2]) >= 12
    ]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ("assign", "access", "hex")
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))


def test_secrets_match_the_plain_patterns(spark, rows):
    found = QUERIES["op6_secrets"](spark, SF_DIR).collect()
    texts = {r.doc_id: r.text for r in rows}
    for r in found:
        base = plain_secrets(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_windows_have_the_entropy():
    draw = random.Random(6)
    for _ in range(50):
        run = "".join(draw.choice("0123456789abcdef") for _ in range(draw.randrange(20, 70)))
        spans = list(secrets.high_windows(run, 3.2))
        inside = set()
        for i in range(len(run) - 19):
            counts = Counter(run[i : i + 20]).values()
            if -sum(c / 20 * math.log2(c / 20) for c in counts) >= 3.2:
                inside |= set(range(i, i + 20))
        assert {i for a, b in spans for i in range(a, b)} == inside


def test_entropy_suppresses_ordinary_strings():
    quiet = "internationalizationalistically 2024-01-01T00:00:00+00:00 path/to/some/file/number/12 " + "=" * 40
    assert secrets.entropy_spans(quiet) == []
    key = "zK9xQ2mP7vL4wR8tY1uB5nC3"
    text = f"see {key} here"
    assert secrets.joined(secrets.entropy_spans(text)) == "entropy_base64:4:28"
    assert secrets.redacted(text, secrets.entropy_spans(text)) == "see [secret] here"


def test_redaction_keeps_other_columns(spark):
    docs = documents(spark)
    before = {(r.doc_id, r.source): r for r in docs.collect()}
    for r in secrets.without_secrets(docs).collect():
        old = before[r.doc_id, r.source]
        assert r.text == (old.text and old.text.replace('password = "abcdef0123456789', "[secret]"))
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert (r.row, r.key, r.n) == ("x", "y", 1)


# --- Sharding, classifier, mixing --------------------------------------------------------------


def test_lookup_table_is_fair_and_stable():
    names = sharding.shard_names(10)
    table = sharding.filled_table(names, 1009)
    sizes = Counter(table).values()
    assert len(table) == 1009 and max(sizes) - min(sizes) <= 1
    fewer = sharding.filled_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.15 * 1009
    for names, slots in (([], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.filled_table(names, slots)


def test_classifier_is_right_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, marks = read_documents(spark, sf_dir), read_labels(spark, sf_dir)
    model = classifier.trained(docs, marks)
    assert 0 < len(model.rules) < 200
    tested = classifier.classified(docs, model).join(marks, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in tested) / len(tested) > 0.97


def test_compiled_rules_score_like_arrays(spark):
    draw = np.random.default_rng(7)
    x = draw.random((600, len(classifier.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    model = classifier.fit(x, y)
    margin = model.intercept + sum(w * classifier.holds(r, x) for r, w in model.rules)
    assert ((margin > 0) == y).mean() > 0.97
    frame = spark.createDataFrame(
        [tuple(map(float, r)) for r in x[:50]], [f"stat_{n}" for n in classifier.STATISTICS]
    )
    found = [r[0] for r in frame.select(model.score()).collect()]
    assert found == pytest.approx((1 / (1 + np.exp(-margin[:50]))).tolist())


def test_targets_are_capped_and_share_the_rest(spark):
    sizes = spark.createDataFrame(
        [("a", "a", 10), ("b", "b", 1000), ("c", "c", 990), ("n", None, 0)],
        "queue string, source string, source_size long",
    )
    found = {r.queue: r.target for r in mixing.source_targets(sizes).collect()}
    assert found["a"] == 30 and found["n"] == 0
    assert found["b"] == pytest.approx(1970 * 2 / 5) and found["c"] == pytest.approx(1970 * 3 / 5)


def brute_mix(rows, weights=(1, 2, 3), repeats=3):
    """Ids in the order of the mix: queues by an md5 of the id, merged by finish time, up to the budget."""
    queues = {}
    for i, text, _, source in rows:
        queues.setdefault(source, []).append((hashlib.md5(f"mix{i}".encode()).hexdigest(), i, len((text or "").split())))
    names = sorted((s for s in queues if s is not None)) + [None] * (None in queues)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    size = {s: sum(n for _, _, n in queues[s]) for s in names}
    target, left, free = {}, sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if repeats * size[s] <= level * weight[s]}
        if not full:
            break
        target |= {s: float(repeats * size[s]) for s in full}
        free -= full
        left -= sum(repeats * size[s] for s in full)
    target |= {s: weight[s] * level for s in free}
    copies = []
    for s in names:
        sent = 0
        for _ in range(repeats):
            for _, i, n in sorted(queues[s]):
                sent += n
                if n:
                    name = "n" if s is None else "s" + s
                    copies.append((int(sent / target[s] * 2**32), name, sent, i, n))
    taken, budget = [], sum(size.values())
    for *_, i, n in sorted(copies):
        budget -= n
        if budget < 0:
            break
        taken.append(i)
    return taken


def test_mix_is_in_order_and_takes_repeated_rows_in_part(spark):
    """A third of all rows are one row of source b; its copies are as many as the target allows."""
    rows = [(i, f"w{i} " * (i % 7), "en", ["a", "b", None, "c"][i % 4]) for i in range(300)]
    rows += [(1000, "the same row", "en", "b")] * 150
    expected = brute_mix(rows)
    found = mixing.mixed_documents(documents(spark, rows))
    assert found.columns == documents(spark).columns
    assert [r.doc_id for r in found.collect()] == expected
    mixed = mixing.mix(documents(spark, rows).repartition(7)).collect()
    assert len(mixed) == len(rows)
    counts = Counter(expected)
    total = Counter()
    for r in mixed:
        total[r.doc_id] += r.copies
        assert (r.position is None) == (r.copies == 0) and r.copies <= 3
        assert r.position is None or expected[r.position - 1] == r.doc_id
    assert +total == counts
    assert len({r.copies for r in mixed if r.doc_id == 1000}) == 2
    taken = sum(r.size * r.copies for r in mixed if r.source == "b")
    assert abs(taken - next(r.target for r in mixed if r.source == "b")) <= 7


def test_mix_is_cut_within_a_range(spark):
    """Every range of the merge is small: all but the last are whole, and positions go on."""
    rows = [(i, f"w{i} " * (1 + i % 5), "en", "abc"[i % 3]) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [r.doc_id for r in mixing.mixed_documents(documents(spark, rows)).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute_mix(rows)


def test_letters_alone_and_dates_do_not_hide_secrets():
    key = "xKqZpLmNvBtRwYsDfGhJ"
    for text in (key, f"a {key} b", "kQzXvBnM/pLwErTyUiOpAs", "2024-05-06" + "xK9qZpL4mNvBtRw7YsDfGhJ"):
        assert secrets.entropy_spans(text), text
    for text in (
        "abcdefghijklmnopqrstuvw", "ABCDEFGHIJKLMNOPQRSTUVW", "someVeryLongCamelCaseName", "path/to/ThatLongFile_Name",
        "2024-05-06T10-11-12Z_build", "2024-05-06_path/to/that-long-file", "word-and-word-2024-word",
    ):
        assert not secrets.entropy_spans(text), text


# --- Pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = read_documents(spark, SF_DIR)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, SF_DIR)
        if name == "packing":
            totals = {r.doc_id: r.doc_tokens for r in after.collect()}
            assert set(totals) == set(before)
            break
        assert after.columns == columns
        kept = {r.doc_id: r.text for r in after.collect()}
        assert kept.keys() <= before.keys() and kept
        if name == "quality classifier":
            model = classifier.trained(docs, read_labels(spark, SF_DIR))
            good = classifier.classified(docs, model).filter("predicted = 1").collect()
            assert kept.keys() == {r.doc_id for r in good}
        elif name == "near-duplicates":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i], i)
            assert kept.keys() <= set(first.values())
            sets = {
                i: set(simhash.shingle_hashes(simhash.text_words(t), 5).tolist())
                for i, t in before.items()
            }

            def like(a, b):
                return len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))

            for i in before.keys() - kept.keys():  # nothing clean goes
                assert max(like(i, j) for j in before if j != i) >= 0.8
            close = [(a, b) for a in kept for b in kept if a < b and like(a, b) >= 0.8]
            assert not close
        elif name == "secret scans":
            for i, t in kept.items():
                spans = secrets.known_forms(before[i]) + secrets.entropy_spans(before[i])
                assert t == secrets.redacted(before[i], spans)
        docs = spark.createDataFrame(after.collect(), after.schema)


def test_pipeline_is_registered_and_runs(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.count() > 50
    assert {"doc_id", "sequence_id", "offset"} <= set(found.columns)

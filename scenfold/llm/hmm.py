"""Language-model scores: a hidden Markov model over words, trained by Baum-Welch.

Words of training documents are counted, all of them. The most frequent ``OWN`` words are symbols of their own, the
end of a text is another, and every other word belongs to one of ``CLASSES`` symbols by its last
two characters. States emit symbols; within a class a word has its share of the class's counts, with
half a count for every word and for the unknown. The score is the logarithm of the exact probability of a text:
the scaled forward recursion over its symbols, and its words' shares of their classes.

Scale: the counts are one combined sum; the model has STATES x (OWN + CLASSES + 1) numbers whatever the data.
An E-step is one pass over stored symbol sequences; every task sends its expected counts once.
The ``KNOWN`` most frequent words, a fixed number, are looked up where a text is read; only rarer ones are joined
with the counts, so no joined word is in a large share of the rows. Long texts are cut into segments:
in training these are sequences of their own, in scoring their transfer matrices are multiplied, which is exact.

Edge cases: a null or empty text is its end alone; a null id counts as training; without training
documents every word is unknown and the symbols are equally likely; repeated rows are scored each; no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content, fold, lower_ascii, stored, words

STATES = 8
OWN = 4096
CLASSES = 256
KNOWN = 65536
ITERATIONS = 6
SEGMENT = 256
LANES = 1024
STICKY = 0.9
SEED = 7
EMISSION_PRIOR = 200.0  # counts, spread by the words' overall frequency
MOVE_PRIOR = 1.0
UNIT = 1 << 20  # expected counts are summed as whole numbers of 2^-20
HELD_OUT_FOLD = 1


# --- Counts ------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


def class_of(word: Column) -> Column:
    return (F.crc32(F.substring(word, -2, 2).cast("binary")) % CLASSES).cast("int")


def class_of_bytes(word: bytes) -> int:
    return zlib.crc32(word.decode()[-2:].encode()) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over training documents; the end of a text is the empty word."""
    tokens = F.concat(words(lower_ascii(content(F.col("text")))), F.array(F.lit("")))
    return (
        docs.filter(~held_out(F.col("doc_id")))
        .select(F.explode(tokens).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("c"))
    )


@dataclass
class Vocabulary:
    """The most frequent words by rank, and what all words sum up to."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    types: int
    class_tokens: np.ndarray
    class_types: np.ndarray

    def base(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def within(self, c, k):
        """log10 of a word's share of its class."""
        return np.log10((c + 0.5) / (self.class_tokens[k] + 0.5 * (self.class_types[k] + 1)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    frequent = counts.filter("word <> ''").orderBy(F.col("c").desc(), "word").limit(KNOWN).toArrow()
    listed = [w.encode() for w in frequent.column("word").to_pylist()]
    c = frequent.column("c").to_numpy().astype(np.int64)
    sums = (
        counts.groupBy(F.when(F.col("word") == "", -1).otherwise(class_of(F.col("word"))).alias("k"))
        .agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).collect()
    )
    tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    ends = sum(r.tokens for r in sums if r.k == -1)
    for r in sums:
        if r.k >= 0:
            tokens[r.k], types[r.k] = r.tokens, r.types
    all_tokens, all_types = int(tokens.sum()) + ends, int(types.sum()) + (ends > 0)
    for word, n in zip(listed[:OWN], c[:OWN].tolist(), strict=True):  # they are not of a class
        tokens[class_of_bytes(word)] -= n
        types[class_of_bytes(word)] -= 1
    return Vocabulary(listed, c, ends, all_tokens, all_types, tokens, types)


# --- Sequences ---------------------------------------------------------------------------------

END_SYMBOL = OWN + CLASSES
SYMBOLS = OWN + CLASSES + 1


def sequences(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row per document: its symbols, what its known words add to the scores, and its other words.

    ``uid`` tells rows apart; it is made once, as the frame is stored.
    """
    ranks = {w: i for i, w in enumerate(vocab.words)}
    classes = np.array([class_of_bytes(w) for w in vocab.words], np.int64)
    symbols = np.where(np.arange(len(ranks)) < OWN, np.arange(len(ranks)), OWN + classes)
    base = vocab.base(vocab.counts)
    within = np.where(
        np.arange(len(ranks)) < OWN, 0.0, vocab.within(vocab.counts, classes)
    ) if ranks else base
    end_base, end_known = float(vocab.base(vocab.ends)), int(vocab.ends > 0)

    def row(text: str | None):
        split = (text or "").encode().lower().split()
        at = np.fromiter((ranks.get(w, -1) for w in split), np.int64, len(split))
        unknown = np.nonzero(at < 0)[0]
        known = at[at >= 0]
        found = np.empty(len(split) + 1, np.uint16)
        found[-1] = END_SYMBOL
        if len(known):
            found[np.nonzero(at >= 0)[0]] = symbols[known]
        rare: dict[bytes, int] = {}
        for i in unknown.tolist():
            word = split[i]
            rare[word] = rare.get(word, 0) + 1
            found[i] = OWN + class_of_bytes(word)
        return (
            len(split) + 1, len(known) + end_known, float(base[known].sum()) + end_base,
            float(within[known].sum()), found.tobytes(),
            [{"word": w.decode(), "n": n} for w, n in rare.items()],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                rows = [row(t.as_py()) for t in batch.column("text")]
                columns = list(zip(*rows, strict=True))
                rare = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + len(rows))), batch.column("doc_id"),
                        batch.column("held_out"), pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
                        pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.binary()),
                        pa.array(columns[5], rare),
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "within",
                     "symbols", "rare"],
                )
                uid += len(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run,
        f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, "
        "within double, symbols binary, rare array<struct<word:string,n:long>>",
    )


# --- The model ---------------------------------------------------------------------------------


@dataclass
class Hmm:
    start: np.ndarray  # of a text
    resume: np.ndarray  # of a later segment, in training
    move: np.ndarray
    emit: np.ndarray  # states x symbols


def symbol_frequencies(vocab: Vocabulary) -> np.ndarray:
    own = np.zeros(OWN)
    own[: min(OWN, len(vocab.counts))] = vocab.counts[:OWN]
    known = np.concatenate([own, vocab.class_tokens, [vocab.ends]]) + 0.5
    return known / known.sum()


def first_model(vocab: Vocabulary) -> Hmm:
    """States that emit the overall frequencies times noise, and rarely change."""
    noise = np.random.default_rng(SEED).normal(0, 1, (STATES, SYMBOLS))
    emit = symbol_frequencies(vocab) * np.exp(noise)
    move = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1))
    np.fill_diagonal(move, STICKY)
    even = np.full(STATES, 1 / STATES)
    return Hmm(even, even, move, emit / emit.sum(1, keepdims=True))


def expected_counts(model: Hmm, segments: list[np.ndarray], first: list[bool]) -> list[np.ndarray]:
    """Expected starts, resumes, moves and emissions of segments (forward-backward)."""
    starts, resumes = np.zeros(STATES), np.zeros(STATES)
    moves, emissions = np.zeros((STATES, STATES)), np.zeros(STATES * SYMBOLS)
    emit = np.ascontiguousarray(model.emit.T)
    order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
    for begin in range(0, len(order), LANES):
        lanes = order[begin : begin + LANES]
        lengths = np.array([len(segments[i]) for i in lanes])
        is_first = np.array([first[i] for i in lanes])
        seen = np.zeros((lengths[0], len(lanes)), np.int64)
        for lane, i in enumerate(lanes):
            seen[: lengths[lane], lane] = segments[i]
        active = [(lengths > t).sum() for t in range(lengths[0])]
        forward, scale = [], []
        for t, n in enumerate(active):
            now = emit[seen[t, :n]]
            if t == 0:
                now = now * np.where(is_first[:, None], model.start, model.resume)
            else:
                now = (forward[-1][:n] @ model.move) * now
            total = now.sum(1, keepdims=True)
            scale.append(total)
            forward.append(now / total)
        ahead = np.ones((active[-1], STATES))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if len(ahead) < n:  # lanes that end here
                ahead = np.concatenate([ahead, np.ones((n - len(ahead), STATES))])
            posterior = forward[t] * ahead
            flat = seen[t, :n, None] + np.arange(STATES) * SYMBOLS
            emissions += np.bincount(flat.ravel(), posterior.ravel(), STATES * SYMBOLS) if n > 256 else 0
            if n <= 256:
                np.add.at(emissions, flat, posterior)
            if t == 0:
                starts += posterior[is_first].sum(0)
                resumes += posterior[~is_first].sum(0)
            else:
                later = emit[seen[t, :n]] * ahead / scale[t]
                moves += model.move * (forward[t - 1][:n].T @ later)
                ahead = later @ model.move.T
    return [starts, resumes, moves.ravel(), emissions]


def updated(model: Hmm, sums: np.ndarray, overall: np.ndarray) -> Hmm:
    """The model that the expected counts, with their priors, give."""
    starts, resumes, moves, emissions = np.split(
        sums, np.cumsum([STATES, STATES, STATES * STATES])
    )
    moves = moves.reshape(STATES, STATES) + MOVE_PRIOR
    emit = emissions.reshape(STATES, SYMBOLS) + EMISSION_PRIOR * overall
    return Hmm(
        (starts + MOVE_PRIOR) / (starts + MOVE_PRIOR).sum(),
        (resumes + MOVE_PRIOR) / (resumes + MOVE_PRIOR).sum(),
        moves / moves.sum(1, keepdims=True),
        emit / emit.sum(1, keepdims=True),
    )


def trained(made: DataFrame, vocab: Vocabulary, iterations: int = ITERATIONS) -> Hmm:
    """Baum-Welch over the training rows of stored sequences."""
    model, overall = first_model(vocab), symbol_frequencies(vocab)
    size = 2 * STATES + STATES * STATES + STATES * SYMBOLS
    for _ in range(iterations):
        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for whole in batches:
                for i in range(0, whole.num_rows, 1000):
                    segments, first = [], []
                    for raw in whole.column("symbols").slice(i, 1000):
                        seen = np.frombuffer(raw.as_py(), np.uint16)
                        for begin in range(0, len(seen), SEGMENT):
                            segments.append(seen[begin : begin + SEGMENT])
                            first.append(begin == 0)
                    sums += np.concatenate(expected_counts(model, segments, first))
            whole = np.round(sums * UNIT).astype(np.int64)
            cells = np.nonzero(whole)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(whole[cells])], ["cell", "units"]
            )

        found = (
            made.filter("not held_out").select("symbols")
            .mapInArrow(run, "cell long, units long")
            .groupBy("cell").agg(F.sum("units").alias("units")).toArrow()
        )
        sums = np.zeros(size)
        sums[found.column("cell").to_numpy()] = found.column("units").to_numpy() / UNIT
        model = updated(model, sums, overall)
    return model


def log_likelihoods(model: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the exact probability of every sequence of symbols.

    The forward vector of a text is its start times the product of the transfer matrices of its segments; segments
    of all texts are multiplied out side by side.
    """
    emit = np.ascontiguousarray(model.emit.T)
    vectors = model.start * emit[np.array([t[0] for t in texts])]
    logs = np.zeros(len(texts))
    pieces = [
        (row, t[begin : begin + SEGMENT])
        for row, t in enumerate(texts) for begin in range(1, len(t), SEGMENT)
    ]
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i][1]))
    matrices = np.empty((len(pieces), STATES, STATES))
    scales = np.zeros(len(pieces))
    for begin in range(0, len(order), LANES):
        lanes = order[begin : begin + LANES]
        lengths = np.array([len(pieces[i][1]) for i in lanes])
        seen = np.zeros((lengths[0], len(lanes)), np.int64)
        for lane, i in enumerate(lanes):
            seen[: lengths[lane], lane] = pieces[i][1]
        product = np.repeat(np.eye(STATES)[None], len(lanes), 0)
        log = np.zeros(len(lanes))
        for t in range(lengths[0]):
            n = (lengths > t).sum()
            moved = (product[:n].reshape(-1, STATES) @ model.move).reshape(n, STATES, STATES)
            product[:n] = moved * emit[seen[t, :n]][:, None, :]
            if t % 16 == 15:
                most = product[:n].max((1, 2))
                product[:n] /= most[:, None, None]
                log[:n] += np.log10(most)
        matrices[lanes], scales[lanes] = product, log
    rows = np.array([r for r, _ in pieces], np.int64)
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)  # of a segment in its text
    for k in range(int(turn.max()) + 1 if len(turn) else 0):
        now = np.nonzero(turn == k)[0]
        moved = np.einsum("ns,nst->nt", vectors[rows[now]], matrices[now])
        total = moved.sum(1)
        vectors[rows[now]] = moved / total[:, None]
        logs[rows[now]] += np.log10(total) + scales[now]
    return logs + np.log10(vectors.sum(1))


# --- Scores ------------------------------------------------------------------------------------


def scored(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Every document's token counts, its unigram ``base_score`` and its ``score`` by the model."""
    counts = stored(word_counts(docs))
    vocab = vocabulary(counts)
    made = stored(sequences(docs, vocab))
    model = trained(made, vocab, iterations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                texts = [np.frombuffer(raw.as_py(), np.uint16) for raw in batch.column("symbols")]
                kept = batch.drop_columns(["symbols"])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(log_likelihoods(model, texts))],
                    [*kept.schema.names, "chain"],
                )

    fields = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "within"]
    kinds = ", ".join(f"{f} {made.schema[f].dataType.simpleString()}" for f in fields)
    chains = made.select(*fields, "symbols").mapInArrow(run, f"{kinds}, chain double")

    def constants(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    k = class_of(F.col("word"))
    room = constants(vocab.class_tokens + 0.5 * (vocab.class_types + 1))
    c = F.coalesce(F.col("c"), F.lit(0)) + 0.5
    rare = made.select("uid", F.inline("rare")).join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10(c / (vocab.tokens + 0.5 * (vocab.types + 1)))).alias("rare_base"),
        F.sum(F.col("n") * F.log10(c / F.get(room, k))).alias("rare_within"),
    )
    return chains.join(rare, "uid", "left").fillna(
        0, ["rare_known", "rare_base", "rare_within"]
    ).select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"),
        (F.col("chain") + F.col("within") + F.col("rare_within")).alias("score"),
    )

"""Adaptive context-mixing range coder for token ids, and files of coded blocks.

A block is coded on its own: its model starts empty and its ids carry a checksum. Its ids are cut
into lanes that advance together, so that a step is array arithmetic over all lanes; the model is
shared by the lanes and adapts after every step.

Model. The last id after the same two ids (order 2) and after the same id (order 1) are predictions.
The chance that the order-2 prediction is right is mixed, in the logistic domain and with weights that adapt, from three
estimates: by how often its context was right, by how often the order-1 context was, and by the order-0 frequency of
the predicted id. If it fails, the order-1 prediction is tried; if that fails, the id is coded by its order-0 frequency.
All arithmetic is on whole numbers, so any machine decodes what another coded. However sure the predictions are, they
leave every id a part of the interval; without one, its lane would be shifted without end.

Scale: documents are sorted by id in range partitions, and every task writes its blocks in order as
rows of a Parquet file; a lost task is run again. Blocks hold whole documents, at least
``BLOCK`` ids where there are as many; memory is that of a block or of its longest document, and of the words that
the worker's tokenizer keeps.

Edge cases: a null or empty text is its end id alone; a null id comes first; equal ids are ordered by text and
stay one row each; a damaged block raises an error; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import WORD_LEVEL, encoder, sized

MAGIC, VERSION = b"CMRC", 3
HEADER = struct.Struct("<4sHHIII")  # magic, version, bits of an id, ids, lanes, checksum
BLOCK = 1 << 21
LANES, LANE_IDS = 4096, 256
ID_BITS = 16

TOTAL_BITS = 30  # of the interval that a step divides
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
LEAST, MOST = 64, 62500  # chances, of 65536, that a prediction may have
FREQUENCY_BITS = 20  # ids not yet seen keep a 16th of the shares
FREQUENCY_TOTAL = 1 << FREQUENCY_BITS  # of the interval are left to the order-0 shares, so each id's part is 1 or more
SUREST = 65536 - (2 * FREQUENCY_TOTAL >> TOTAL_BITS - 16)  # an order-2 prediction leaves twice that
WARM_STEPS = 64  # all of which adapt the chances; later, every eighth does
REFRESH = 16  # steps between two tables of order-0 frequencies
HASH_BITS = 18
TRUST_BITS = 4
CONFIDENCE = (1 << TRUST_BITS) - 1
WEIGHT_ONE = 1 << 16


def logistic_tables() -> tuple[np.ndarray, np.ndarray]:
    """``squash`` of -2047..2047 (in 1/256) to 16 bits, and its inverse by 12-bit chance."""
    x = np.arange(-2047, 2048)
    squash = np.round(65536 / (1 + np.exp(-x / 256.0))).astype(np.int64)
    stretch = np.searchsorted(squash, (np.arange(4096) * 16 + 8)).clip(0, 4094) - 2047
    return np.minimum(squash, SUREST), stretch.astype(np.int64)


SQUASH, STRETCH = logistic_tables()


class Model:
    """Predictions for a step of lanes, from all steps before it.

    A prediction is one number: the id, and below it ``TRUST_BITS`` bits of how often it was right.
    """

    def __init__(self):
        size = 1 << ID_BITS
        self.counts = np.zeros(size, np.int64)
        self.pending: list[np.ndarray] = []
        self.steps = 0
        self.second = np.zeros(1 << HASH_BITS, np.int32)
        self.first = np.zeros(size, np.int32)
        n = CONFIDENCE + 1
        self.by_second = np.full(n, 4096, np.int64)
        self.by_first = np.full(2 * n, 4096, np.int64)
        self.by_frequency = np.full(FREQUENCY_BITS + 2, 2048, np.int64)
        self.alone = np.full(n, 4096, np.int64)  # of the order-1 prediction after the other failed
        self.weights = np.full(3, WEIGHT_ONE * 2 // 5, np.int64)
        self.refresh()
        self.weighed()

    def refresh(self) -> None:
        """New shares of the ids from their counts; every id has one, so any can be coded."""
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=len(self.counts))
            self.pending = []
        room = FREQUENCY_TOTAL - len(self.counts)
        share = 1 + self.counts * room // max(1, int(self.counts.sum()))
        share[self.counts.argmax()] += FREQUENCY_TOTAL - int(share.sum())
        self.cumulative = np.zeros(len(share) + 1, np.int64)
        np.cumsum(share, out=self.cumulative[1:])
        self.id_at = None  # decoding alone needs it
        self.magnitude = np.frexp(share.astype(np.float32))[1].astype(np.int32)  # bits of a share

    def weighed(self) -> None:
        """The inputs and their weighted parts by context."""
        self.stretched = [STRETCH[x >> 4] for x in (self.by_second, self.by_first, self.by_frequency)]
        self.parts = [w * x for w, x in zip(self.weights.tolist(), self.stretched, strict=True)]
        self.single = self.alone.clip(LEAST, MOST)

    def predict(self, before: np.ndarray, last: np.ndarray) -> None:
        """Set the predictions ``p2`` and ``p1`` and the ends of their parts of the interval."""
        self.at2 = ((before * 40503 + last) * 2654435761 >> 12) & ((1 << HASH_BITS) - 1)
        self.at1 = last
        self.held2, self.held1 = self.second.take(self.at2), self.first.take(last)
        self.p2, self.p1 = self.held2 >> TRUST_BITS, self.held1 >> TRUST_BITS
        self.trust2, self.trust1 = self.held2 & CONFIDENCE, self.held1 & CONFIDENCE
        same = self.p2 == self.p1
        self.contexts = (self.trust2, 2 * self.trust1 + same, self.magnitude.take(self.p2))
        mixed = sum(part.take(at) for part, at in zip(self.parts, self.contexts, strict=True)) >> 16
        self.chance = SQUASH.take(np.clip(mixed, -2047, 2047, out=mixed) + 2047)
        single = np.where(same, LEAST, self.single.take(self.trust1))
        self.end2 = self.chance << (TOTAL_BITS - 16)
        self.end1 = self.end2 + (((1 << TOTAL_BITS) - FREQUENCY_TOTAL - self.end2) * single >> 16)
        self.rest = (1 << TOTAL_BITS) - self.end1

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of the ids' parts of the interval."""
        self.hit1, self.hit2 = ids == self.p1, ids == self.p2
        low = self.end1 + (self.cumulative.take(ids) * self.rest >> FREQUENCY_BITS)
        high = self.end1 + (self.cumulative.take(ids + 1) * self.rest >> FREQUENCY_BITS)
        hit = np.flatnonzero(self.hit1)
        low[hit], high[hit] = self.end2.take(hit), self.end1.take(hit)
        hit = np.flatnonzero(self.hit2)
        low[hit], high[hit] = 0, self.end2.take(hit)
        return low, high - low

    def ids_in(self, value: np.ndarray) -> np.ndarray:
        """The ids whose part of the interval has the value."""
        ids = np.where(value < self.end2, self.p2, self.p1).astype(np.int64)
        other = np.flatnonzero(value >= self.end1)
        inside = value.take(other) - self.end1.take(other) + 1
        # Both are positive; whole numbers without a sign are divided faster.
        place = ((inside << FREQUENCY_BITS) - 1).view(np.uint64) // self.rest.take(other).view(np.uint64)
        if self.id_at is None:
            every = np.arange(len(self.counts), dtype=np.uint16)
            self.id_at = np.repeat(every, np.diff(self.cumulative))
        ids[other] = self.id_at.take(place.view(np.int64), mode="clip")
        return ids

    def update(self, ids: np.ndarray) -> None:
        """Learn from the ids of a step, after ``interval``."""
        hit1, hit2 = self.hit1, self.hit2
        if self.steps % 8 == 0 or self.steps < WARM_STEPS:
            missed = ~hit2
            error = (hit2.astype(np.int64) << 16) - self.chance
            for i, (x, at) in enumerate(zip(self.stretched, self.contexts, strict=True)):
                self.weights[i] += int((x[at] * error).sum()) // (len(ids) * 2048)
            for chances, at in zip((self.by_second, self.by_first, self.by_frequency), self.contexts, strict=True):
                adapt(chances, at, hit2)
            adapt(self.alone, self.trust1[missed], hit1[missed])
            self.weighed()
        fresh = (ids.astype(np.int32) << TRUST_BITS) + 1
        self.second[self.at2] = learned(self.held2, self.trust2, hit2, fresh)
        self.first[self.at1] = learned(self.held1, self.trust1, hit1, fresh)
        self.pending.append(ids)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps < REFRESH:
            self.refresh()


def adapt(chances: np.ndarray, contexts: np.ndarray, hits: np.ndarray) -> None:
    """Move the contexts' chances towards what happened."""
    both = np.bincount(2 * contexts + hits, minlength=2 * len(chances)).reshape(-1, 2)
    seen = both.sum(1)
    chances += ((both[:, 1] << 16) - seen * chances) // (seen + 256)
    np.clip(chances, LEAST, 65535 - LEAST, out=chances)


def learned(held: np.ndarray, trust: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """A right prediction gains trust; a wrong one loses half, and is replaced when it has none."""
    lost = np.where(trust <= 1, fresh, held - trust + (trust >> 1))
    return np.where(hit, held + (trust < CONFIDENCE), lost)


def lanes_of(n: int) -> tuple[int, np.ndarray]:
    """How many lanes a block of ``n`` ids has, and where they start; the first may be longer by one."""
    lanes = int(min(LANES, max(1, n // LANE_IDS)))
    sizes = np.full(lanes, n // lanes, np.int64)
    sizes[: n % lanes] += 1
    return lanes, np.concatenate([[0], np.cumsum(sizes)])


def steps_of(starts: np.ndarray, n: int, lanes: int) -> Iterator[tuple[int, int]]:
    """Step and number of lanes that still have ids."""
    for step in range(-(-n // lanes)):
        yield step, lanes if (step + 1) * lanes <= n else n - step * lanes


def encode_block(ids: np.ndarray) -> bytes:
    """A coded block of ids below 2^16."""
    ids = np.asarray(ids)
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() >= 1 << ID_BITS):
        raise ValueError(f"an id has more than {ID_BITS} bits")
    lanes, starts = lanes_of(n)
    low = np.zeros(lanes, np.uint64)
    width = np.full(lanes, (1 << 64) - 1, np.uint64)
    before, last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    model, out = Model(), []
    for step, active in steps_of(starts, n, lanes):
        now = ids.take(starts[:active] + step).astype(np.int64)
        model.predict(before[:active], last[:active])
        begin, size = model.interval(now)
        unit = width[:active] >> np.uint64(TOTAL_BITS)
        low[:active] += unit * begin.astype(np.uint64)
        width[:active] = unit * size.astype(np.uint64)
        renormalized(low, width, lambda at: out.append((at.astype("<u2"), (low[at] >> np.uint64(48)).astype("<u2"))))
        model.update(now)
        before[:active], last[:active] = last[:active].copy(), now
    # Two words name a value within every lane's last interval, which is 2^32 wide or more.
    final = low + (BOTTOM - np.uint64(1))
    every = np.arange(lanes, dtype="<u2")
    out.append((every, (final >> np.uint64(48)).astype("<u2")))
    out.append((every, (final >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2")))
    lane = np.concatenate([a for a, _ in out])
    words = np.concatenate([w for _, w in out])[np.argsort(lane, kind="stable")]
    checksum = zlib.crc32(ids.astype("<u4").tobytes())
    head = HEADER.pack(MAGIC, VERSION, ID_BITS, n, lanes, checksum)
    return head + np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + words.tobytes()


def renormalized(low: np.ndarray, width: np.ndarray, shifted) -> None:
    """Shift out the 16-bit words that are settled, or end an interval that is too narrow."""
    at, lows, widths = None, low, width  # all of them at first
    while len(lows):
        settled = (lows ^ (lows + widths)) < TOP
        due = np.flatnonzero(settled | (widths < BOTTOM))
        if not len(due):
            return
        at, lows, widths = due if at is None else at.take(due), lows.take(due), widths.take(due)
        cut = np.flatnonzero(~settled.take(due))
        widths[cut] = (~lows.take(cut) + np.uint64(1)) & (BOTTOM - np.uint64(1))
        shifted(at)
        lows, widths = lows << np.uint64(16), widths << np.uint64(16)
        low[at], width[at] = lows, widths


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if it is not a whole, undamaged one."""
    if len(block) < HEADER.size:
        raise ValueError("the block is cut short")
    magic, version, bits, n, lanes, checksum = HEADER.unpack_from(block)
    if (magic, version, bits) != (MAGIC, VERSION, ID_BITS) or lanes != lanes_of(n)[0]:
        raise ValueError("not a block of this format")
    lengths = np.frombuffer(block, "<u4", lanes, HEADER.size).astype(np.int64)
    if len(block) != HEADER.size + 4 * lanes + 2 * int(lengths.sum()):
        raise ValueError("the block is cut short")
    words = np.frombuffer(block, "<u2", -1, HEADER.size + 4 * lanes)
    words = np.concatenate([words, np.zeros(4, "<u2")])
    ends = np.cumsum(lengths)
    reading = ends - lengths

    code = np.zeros(lanes, np.uint64)

    def read(at: np.ndarray) -> None:
        place = reading.take(at)
        word = np.where(place < ends.take(at), words.take(place, mode="clip"), np.uint16(0))
        code[at] = code.take(at) << np.uint64(16) | word
        reading[at] = place + 1

    _, starts = lanes_of(n)
    ids = np.zeros(n, "<u4")
    low = np.zeros(lanes, np.uint64)
    width = np.full(lanes, (1 << 64) - 1, np.uint64)
    before, last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for _ in range(4):
        read(np.arange(lanes))
    model = Model()
    most = (1 << TOTAL_BITS) - 1
    for step, active in steps_of(starts, n, lanes):
        model.predict(before[:active], last[:active])
        unit = width[:active] >> np.uint64(TOTAL_BITS)
        value = np.minimum((code[:active] - low[:active]) // unit, np.uint64(most)).astype(np.int64)
        now = model.ids_in(value)
        begin, size = model.interval(now)
        low[:active] += unit * begin.astype(np.uint64)
        width[:active] = unit * size.astype(np.uint64)
        renormalized(low, width, read)
        model.update(now)
        ids[starts[:active] + step] = now
        before[:active], last[:active] = last[:active].copy(), now
    if zlib.crc32(ids) != checksum:
        raise ValueError("the block's checksum does not match its ids")
    return ids


# --- Files -------------------------------------------------------------------------------------


def write_blocks(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, kind: str = WORD_LEVEL,
    block: int = BLOCK,
) -> None:
    """Write the ids of all documents, in ascending order of their ids, to files under ``path``.

    Rows of the files are blocks: ``part`` and ``block`` put them in order, ``before`` and ``size`` count the ids
    before it in its part and in it, ``doc_ids`` and ``lengths`` say whose ids a block has.
    """
    end = int(end_id).to_bytes(4, "little")
    id_type = pa.int64()

    def coded(part: int, number: int, before: int, ids: list, held: list[bytes]) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(held), "<u4")
        payload = encode_block(flat)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([number], pa.int64()),
                pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()),
            ],
            ["part", "block", "before", "size", "doc_ids", "lengths", "payload"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, ids, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for whole in batches:
            for batch in sized(whole, "text"):
                found = encoder(tokenizer, kind).encode_column(pc.fill_null(batch.column("text"), ""))
                for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                    ids.append(doc_id)
                    held.append(encoded + end)
                    size += len(encoded) // 4 + 1
                    if size >= block:
                        yield coded(part, number, before, ids, held)
                        number, before, ids, held, size = number + 1, before + size, [], [], 0
        if held:
            yield coded(part, number, before, ids, held)

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    schema = "part int, block long, before long, size long, doc_ids array<long>, lengths array<long>, payload binary"
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_blocks(
    spark: SparkSession, path: str, payload: dict[str, Column] | None = None
) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids before it) and ``n_tokens``.

    ``payload`` names columns made of a document's ``ids`` (little-endian unsigned 32-bit integers):
    the ids themselves unless it says otherwise. Where a part starts comes from the blocks' sizes alone: a row per
    task that wrote blocks, which is broadcast, so what is decoded stays where it is.
    """
    payload = {"ids": F.col("ids")} if payload is None else payload
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("part").agg(F.max(F.col("before") + F.col("size")).alias("in_part"))
    parts = sizes.select(
        "part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one block at a time: a batch may have many
                row = batch.slice(k, 1).to_pylist()[0]
                raw = decode_block(row["payload"]).tobytes()
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                for i in range(0, len(ends), 2000):
                    some = slice(i, i + 2000)
                    cut = zip(begins[some].tolist(), ends[some].tolist(), strict=True)
                    n = len(ends[some])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * n, pa.int32()),
                            pa.array(row["doc_ids"][some], pa.int64()),
                            pa.array(row["before"] + begins[some]), pa.array(lengths[some]),
                            pa.array([raw[4 * a : 4 * b] for a, b in cut], pa.binary()),
                        ],
                        ["part", "doc_id", "within", "n_tokens", "ids"],
                    )

    schema = "part int, doc_id long, within long, n_tokens long, ids binary"
    found = blocks.mapInArrow(run, schema).select(
        "part", "doc_id", "within", "n_tokens", *[c.alias(name) for name, c in payload.items()]
    )
    return found.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", *payload
    )

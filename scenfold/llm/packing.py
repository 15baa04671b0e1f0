"""Packing token pieces into sequences: shortest pack first over the histogram of lengths.

Documents are tokenized, ended by an end id and cut into pieces of at most ``CAPACITY`` ids. Only the
histogram of piece lengths (at most ``CAPACITY`` rows) is planned on the driver: lengths are placed longest first, each into
the packs with the most room, as counts of packing patterns. Pieces then find their place by rank: the
r-th piece of a length goes to the r-th slot of that length among all patterns.

Scale: texts are tokenized once, where they are read; pieces then travel without their ids. Ranks
within a length are counted in ``SLICES`` slices by hash, and slices are put in order by their sums, so a length that a third of
all pieces have is not one task. The plan has at most a few thousand patterns, whatever the data.

Edge cases: a null or empty text is its end id alone; repeated rows are packed as often as they
occur; a piece longer than the capacity cannot be; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import BYTE_LEVEL, encoder

CAPACITY = 1024
SLICES = 1024
END_ID = 0
RANK_BITS = 44

Pattern = tuple[tuple[int, ...], int]  # lengths in order, and how many packs have them


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY,
    kind: str = BYTE_LEVEL,
) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids)`` of all pieces; ids are little-endian 32-bit."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batch: pa.RecordBatch, fields: list[str]) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows, starts, lengths, totals, ids = [], [], [], [], []
        for row, encoded in enumerate(encoder(tokenizer, kind).encode(texts)):
            encoded += end
            total = len(encoded) // 4
            for start in range(0, total, capacity):
                piece = encoded[4 * start : 4 * (start + capacity)]
                rows.append(row)
                starts.append(start)
                lengths.append(len(piece) // 4)
                totals.append(total)
                ids.append(piece)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(rows, pa.int32())),
                *[pa.array(x, pa.int64()) for x in (starts, lengths, totals)],
                pa.array(ids, pa.binary()),
            ],
            fields,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                yield cut(batch.slice(i, 500), ["doc_id", "start", "length", "doc_tokens", "ids"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind_of_id}, start long, length long, doc_tokens long, ids binary"
    )


def packing_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every length as often as the histogram says.

    Packs alike are one entry of a pattern and a count; a length fills the emptiest packs first,
    and opens new ones when it fits none.
    """
    by_room: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=0)
            if room < length:
                by_room[capacity - length].append([(length,), left])
                break
            pack = by_room[room][-1]
            taken = min(left, pack[1])
            by_room[room - length].append([(*pack[0], length), taken])
            left -= taken
            pack[1] -= taken
            if not pack[1]:
                by_room[room].pop()
    return [(lengths, count) for _, packs in sorted(by_room.items()) for lengths, count in packs]


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Ranks of each length by pattern slot, ordered by length and first rank."""
    taken: dict[int, int] = defaultdict(int)
    found, base = [], 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            found.append(((length << RANK_BITS) + taken[length], base, offset))
            taken[length] += count
            offset += length
        base += count
    keys, bases, offsets = np.array(sorted(found), np.int64).reshape(-1, 3).T
    return {"keys": keys, "bases": bases, "offsets": offsets}


def ranked(cut: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank``, from 0 within each length."""
    sliced = cut.withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SLICES)).cast("int")
    )
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.select(
        "length", "slice",
        (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"),
    )
    inside = Window.partitionBy("length", "slice").orderBy(*order)
    return sliced.join(before, ["length", "slice"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inside) - 1
    ).drop("slice", "before")


def packed(
    docs: DataFrame, tokenizer: str, payload: dict[str, Column] | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``.

    ``payload`` names columns made of a piece's ``ids`` that travel with it (the ids themselves, or a digest).
    """
    payload = payload or {}
    cut = stored(
        pieces(docs, tokenizer, capacity=capacity).select(
            "doc_id", "start", "length", "doc_tokens", *[c.alias(n) for n, c in payload.items()]
        )
    )
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = slots(packing_patterns(histogram, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            wanted = (batch.column("length").to_numpy() << RANK_BITS) + rank
            at = np.searchsorted(plan["keys"], wanted, "right") - 1
            sequence = plan["bases"][at] + wanted - plan["keys"][at]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(plan["offsets"][at])],
                [*kept.schema.names, "sequence_id", "offset"],
            )

    rows = ranked(cut, ["doc_id", "start", "doc_tokens", *payload])
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank"
    )
    return rows.mapInArrow(run, f"{fields}, sequence_id long, offset long")

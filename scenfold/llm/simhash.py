"""Near-duplicates by SimHash fingerprints, searched with Golay-code keys; and by shingle sets.

A fingerprint has a bit set where more than half of the hashes of a text's word shingles have it.
Distinct fingerprints get several keys each by decoding their segments (``golay``); those that share
a key are compared, and links join documents into components.

Scale: copies are one row before any search. The search moves 16 rows of 16 bytes per distinct
fingerprint (``linked``). Rows of one key are compared where they meet, without emitting all pairs:
a bucket yields a spanning forest of its links, which has the same components. A bucket of more than
``BUCKET`` fingerprints is dealt out again in blocks, and every two blocks of it are compared, so no
task holds more than two blocks. Components are found by rounds of joins on disk. Hot keys of joins
(a fingerprint, bucket or component with very many rows) are broadcast with their one answer
(``common.spread_join``).
Deduplication searches 32 rows of 48 bytes per distinct set of shingles; only the sets of
candidates are made again. Every candidate link is decided by its two sets; only sets that the links
that hold leave outside the largest piece of their component of candidates meet all its blocks.

Edge cases: a null or empty text, or one of white space, has fingerprint 0, linked like any other; a
text with fewer words than a shingle is one shingle; a null id takes part but names no component (a
component of null ids alone is null); repeated rows are kept; no rows give no rows. Deduplication keeps one
row of a group of null ids alone, and none where the group has an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import spread_join, stored
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
BUCKET = 4096
CHUNK = 1 << 15

# For whole-corpus deduplication: five-word shingles, a Jaccard similarity of 0.8 or more.
SIMILAR_SHINGLE = 5
SIMILAR = (4, 5)
SKETCH_WORDS = 4
# Sketches of sets with a similarity of 0.8 differ in 25.6 of 256 bits, give or take 4.8; this is 7 deviations more.
SKETCH_BITS = 60
SHINGLES = 1 << 19  # in a block of sets to compare
BROADCAST = 1_000_000
# Keys of documents: their ids, or a row's number added to 2^63, beyond all of these.
KEY, AFTER_IDS, ROW = "decimal(20,0)", Decimal(1 << 63), "row_without_id"

# Keys of BANDS times BAND minima: of pairs with a similarity of 0.8, one in 20 million has none in common.
BANDS, BAND = 32, 4
MINIMA = 256
MULTIPLIERS, MASKS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, MINIMA, 1), np.uint32)
MULTIPLIERS |= np.uint32(1)
MINIMA_CHUNK = 512


# --- Fingerprints ------------------------------------------------------------------------------


def text_words(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case; bytes know ASCII letters and white space only."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)),
        np.uint64,
        len(words) - width + 1,
    )


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        octets = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    return majority(shingle_hashes(text_words(text), width))


def remixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes from hashes, another family for every turn."""
    mixed = (hashes ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return mixed ^ mixed >> np.uint64(31)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes in each of ``MINIMA`` orders; two sets have the same least with a
    probability of their Jaccard similarity, in whatever way they differ."""
    low, out = hashes.astype(np.uint32), np.full(MINIMA, -1, np.int32).view(np.uint32)
    for i in range(0, len(low), MINIMA_CHUNK):
        np.minimum(out, ((low[i : i + MINIMA_CHUNK] ^ MASKS) * MULTIPLIERS).min(1), out=out)
    return out


def band_keys(least: np.ndarray) -> bytes:
    """A key of 64 bits for every ``BAND`` minima."""
    pairs = least[: BANDS * BAND].view(np.uint64).reshape(BANDS, BAND // 2)
    keys = pairs[:, 0]
    for other in pairs.T[1:]:
        keys = remixed(keys, 1) ^ other
    return remixed(keys, 2).tobytes()


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text_words(text), SIMILAR_SHINGLE))


def set_name(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(signed([xxhash.xxh64_intdigest(hashes.tobytes(), SEED)])[0])


def sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Keys of a set of shingles, to search by, and 256 bits, one of each of its minima."""
    least = minima(hashes)
    bits = least * np.uint32(0x9E3779B1) >> np.uint32(31)
    return band_keys(least), np.packbits(bits.astype(bool), bitorder="little").tobytes()


def each_key(search: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of all keys, given a row of keys per item."""
    return np.repeat(np.arange(len(search)), search.shape[1]), search.ravel().view(np.int64)


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def with_fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``; the fingerprint is a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(signed(prints))], ["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


# --- Search ------------------------------------------------------------------------------------


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the same rows as all links within the radius do.

    ``prints`` has a row of 64-bit words per item. From each item reached, the items not reached
    yet are compared in one step, and those within the radius leave them for good.
    """
    left, links = np.arange(len(prints)), []
    while len(left) > 1:
        ahead, left = [left[0]], left[1:]
        while ahead and len(left):
            at = ahead.pop()
            apart = np.bitwise_count(prints[left] ^ prints[at]).sum(1, dtype=np.int32)
            near = apart <= radius
            links += [(at, x) for x in left[near].tolist()]
            ahead += left[near].tolist()
            left = left[~near]
    return links


def bucket_links(
    bounds: np.ndarray, prints: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets; ``bounds`` are the buckets' starts, and the end. Small buckets are
    compared all at once, at every distance between two rows of a bucket."""
    sizes = np.diff(bounds)
    small = sizes <= 8
    starts, a, b = bounds[:-1], [], []
    for apart in range(1, 8):
        for first in range(8 - apart):
            rows = starts[small & (sizes > first + apart)] + first
            near = np.bitwise_count(prints[rows] ^ prints[rows + apart]).sum(1, dtype=np.int32) <= radius
            a.append(rows[near])
            b.append(rows[near] + apart)
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        if links := forest(prints[start : start + size], radius):
            left, right = np.array(links).T
            a.append(left + start)
            b.append(right + start)
    return np.concatenate(a), np.concatenate(b)


def compared(keyed: DataFrame, radius: int, words: int, limit: int | None) -> DataFrame:
    """Links ``(u, v, null)`` between rows (key, node, print) of equal key.

    ``print`` holds the bits to compare, ``words`` 64-bit words of them. Rows of keys with more
    than ``limit`` rows come back as ``(node, key, print)``.
    """
    def links(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        a, b = bucket_links(bounds, prints, radius)
        none = pa.nulls(len(a), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[a]), pa.array(nodes[b]), none], ["u", "v", "print"]
        )

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = b"".join(batch.column("print").to_pylist())
        return (
            batch.column("key").to_numpy(zero_copy_only=False),
            batch.column("node").to_numpy(zero_copy_only=False),
            np.frombuffer(raw, np.uint64).reshape(-1, words),
        )

    def returned(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        raw = [p.tobytes() for p in prints]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(keys), pa.array(raw, pa.binary())], ["u", "v", "print"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch may go on in the next."""
        held, overflow = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unpacked(batch)
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            if overflow is not None:  # more of a key that is too large already
                more = rows[0] == overflow
                if more.any():
                    yield returned(*(x[more] for x in rows))
                    rows = tuple(x[~more] for x in rows)
                held = None
                if not len(rows[0]):
                    continue
                overflow = None
            last = rows[0] == rows[0][-1]
            held = tuple(x[last] for x in rows)
            if limit is not None and len(held[0]) > limit:
                overflow = held[0][0]
                yield returned(*held)
                held = None
            rows = tuple(x[~last] for x in rows)
            if len(rows[0]):
                yield from split(rows)
        if held is not None and len(held[0]):
            yield from split(held)

    def split(rows) -> Iterator[pa.RecordBatch]:
        """Links of whole keys, but for those within one batch that are too large."""
        if limit is not None:
            _, place, sizes = np.unique(rows[0], return_inverse=True, return_counts=True)
            large = sizes[place] > limit
            if large.any():
                yield returned(*(x[large] for x in rows))
                rows = tuple(x[~large] for x in rows)
        if len(rows[0]):
            yield links(*rows)

    return keyed.mapInArrow(run, "u long, v long, print binary")


def linked(prints: DataFrame, keys: Callable, radius: int, words: int, bucket: int = BUCKET) -> DataFrame:
    """Links ``(u, v)`` between the rows (node, search, print) that share a key.

    ``search`` is the 64-bit fingerprint, or a row of several as bytes, that ``keys`` makes keys of.
    """
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                search = batch.column("search")
                if pa.types.is_binary(search.type):
                    raw = b"".join(search.to_pylist())
                    search = np.frombuffer(raw, np.uint64).reshape(batch.num_rows, -1)
                else:
                    search = search.to_numpy(zero_copy_only=False).view(np.uint64)
                rows, found = keys(search)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), batch.column("node").take(take), batch.column("print").take(take)],
                    ["key", "node", "print"],
                )

    keyed = prints.mapInArrow(expand, "key long, node long, print binary")
    together = keyed.repartition("key").sortWithinPartitions("key")
    found = stored(compared(together, radius, words, bucket))
    links = found.filter("print is null").select("u", "v")
    large = found.filter("print is not null").select(F.col("v").alias("key"), F.col("u").alias("node"), "print")
    sizes = large.groupBy("key").agg(F.count("*").alias("n"))
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("n") / (bucket // 2)).cast("int")))
    if sizes.isEmpty():
        return links
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = spread_join(large, sizes, "key").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    meeting = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    again = dealt.select(meeting.alias("key"), "node", "print")
    again = again.repartition("key").sortWithinPartitions("key")
    return links.union(compared(again, radius, words, None).select("u", "v"))


# --- Documents ---------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the least id that links of at most two bits reach."""
    prints = stored(with_fingerprints(docs, width))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows")))
    octets = F.unhex(F.lpad(F.hex("fp"), 16, "0"))  # a fixed order of the bits will do
    search = classes.select(F.col("fp").alias("node"), F.col("fp").alias("search"), octets.alias("print"))
    found = stored(components(linked(search, golay.keys_within_2, RADIUS, 1, bucket)))
    named = stored(classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "least_id", "n_rows", F.coalesce("component", "fp").alias("component")
    ))
    least = stored(
        named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    )
    answers = stored(spread_join(named, least, "component").select("fp", "component_id", "n_rows"))
    return spread_join(prints, answers, "fp", "n_rows")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches: what is made of a part is not kept for a whole batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the same sets as all links of a Jaccard similarity of 0.8 or more do.

    Goes on as ``forest`` does, with exact counts.
    """
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(flat, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(flat), bool)
    left, links = np.nonzero(sizes)[0], []
    least, of = SIMILAR
    while len(left) > 1:
        ahead, left = [left[0]], left[1:]
        flat = np.concatenate([places[i] for i in left])
        while ahead and len(left):
            at = ahead.pop()
            starts = np.cumsum(sizes[left]) - sizes[left]
            marked[places[at]] = True
            shared = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            marked[places[at]] = False
            near = of * shared >= least * (sizes[at] + sizes[left] - shared)
            if near.any():
                links += [(at, x) for x in left[near].tolist()]
                ahead += left[near].tolist()
                left = left[~near]
                flat = np.concatenate([places[i] for i in left]) if len(left) else flat[:0]
    return links


def set_links(met: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that join the sets of a key as their similarities of 0.8 or more do.

    ``met`` has (key, node, shingles).
    """
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and node."""
        at, held = None, {}

        def found() -> pa.RecordBatch:
            nodes = list(held)
            pairs = alike([np.frombuffer(x, np.uint64) for x in held.values()])
            return pa.RecordBatch.from_arrays(
                [pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"]
            )

        for batch in sliced(batches):
            for key, node, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "shingles")), strict=True):
                if key != at:
                    if len(held) > 1:
                        yield found()
                    at, held = key, {}
                held[node] = raw
        if len(held) > 1:
            yield found()

    together = met.repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(links, "u long, v long")


def holding(pairs: DataFrame) -> DataFrame:
    """The links ``(u, v)`` of rows (u, v, u_set, v_set) whose sets have a similarity of 0.8 or more."""
    least, of = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            a, b = (batch.column(c).to_pylist() for c in ("u_set", "v_set"))
            keep = []
            for x, y in zip(a, b, strict=True):
                left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(of * shared >= least * (len(left) + len(right) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def checked(made: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate links ``(u, v)`` that hold: each is decided by the exact similarity of its two sets.

    ``made`` has (node, shingles). A node's set comes to its links by ``spread_join``, so a node of
    very many links sends its set to them where they are.
    """
    pairs = candidates.select("u", "v")
    for side in ("u", "v"):
        sets = made.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"))
        degree = pairs.groupBy(side).agg(F.count("*").alias("n"))
        pairs = spread_join(pairs, stored(degree.join(sets, side)), side)
    return holding(pairs)


def similar(docs: DataFrame, groups: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Links ``(u, v)`` between nodes of a group whose sets of shingles have a similarity of 0.8 or more.

    ``groups`` has (node, component, size, least_id); a node's set is that of the text of ``least_id``
    that it names. Every two sets of a component are compared, or reached by links. Given the
    candidate links ``(u, v)`` of the search, each is decided first by its two sets (``checked``);
    the links that hold make pieces, and only sets apart from the largest piece of their component,
    dealt in blocks of their own, then meet each other and that piece (``outsiders``). Without
    them, a large component is dealt in blocks of about ``SHINGLES`` shingles, each of which meets
    the first block in a task, and ``outsiders`` follows for the pieces this leaves.
    """
    groups = stored(groups)
    blocks = stored(groups.groupBy("component").agg(
        F.ceil(F.sum("size") / SHINGLES).cast("int").alias("blocks"), F.count("*").alias("n")
    ))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = stored(spread_join(groups, blocks, "component").withColumn("block", block))
    wanted = F.broadcast(dealt) if dealt.count() <= BROADCAST else dealt
    texts = docs.withColumnRenamed("doc_id", "least_id").join(wanted, "least_id").select(
        "component", "node", "block", "blocks", "text"
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # rows may be repeated, and an id may have other texts
        for batch in sliced(batches):
            rows, found = [], []
            for i, (node, text) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text"), strict=True)):
                if node not in done and set_name(hashes := shingle_set(text.as_py())) == node:
                    done.add(node)
                    rows.append(i)
                    found.append(hashes.tobytes())
            kept = batch.drop_columns(["text"]).take(pa.array(rows, pa.int64()))
            yield kept.append_column("shingles", pa.array(found, pa.binary()))

    made = stored(texts.mapInArrow(sets, "component long, node long, block int, blocks int, shingles binary"))
    if candidates is not None:
        found = stored(checked(made, candidates))
        return found.union(set_links(outsiders(made, components(found))))
    last = F.col("blocks") - 1
    to_first = F.when(F.col("block") == 0, F.sequence(F.least(F.lit(1), last), last)).otherwise(F.array("block"))
    first = made.select("component", F.explode(to_first).alias("to"), "node", "shingles")
    found = set_links(first.select(F.xxhash64("component", "to").alias("key"), "node", "shingles"))
    large = made.filter("blocks > 1")
    if large.isEmpty():
        return found
    found = stored(found)
    return found.union(set_links(outsiders(large, components(found))))


def outsiders(large: DataFrame, pieces: DataFrame) -> DataFrame:
    """Meetings (key, node, shingles) of the sets outside the largest piece of their component.

    ``pieces`` names the sets that are linked so far. Outsiders are dealt in blocks of their own;
    every two of these meet, and each meets every block of the largest piece, whose sets do not meet
    each other again. So the work of a component grows with its size times that of its outsiders.
    """
    pieces = pieces.withColumnRenamed("component", "piece")
    sized = large.select("component", "node", (F.length("shingles") / 8).cast("long").alias("size")).distinct()
    named = stored(sized.join(pieces, "node", "left").withColumn("piece", F.coalesce("piece", "node")))
    sums = stored(named.groupBy("component", "piece").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    per_component = stored(sums.groupBy("component").agg(
        F.max_by("piece", F.struct("size", "piece")).alias("main"),
        F.ceil((F.sum("size") - F.max("size")) / SHINGLES).cast("int").alias("others"),
        F.sum("n").alias("n"),
    ))
    placed = spread_join(named, per_component, "component").filter("others > 0").select(
        "node", "others", (F.col("piece") != F.col("main")).alias("outside")
    )
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("others")).cast("int")

    def meeting(other: bool, i: Column, j: Column) -> Column:
        return F.xxhash64("component", F.lit(other), i, j)

    others, blocks = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("others", "blocks"))
    among = F.transform(others, lambda k: meeting(True, F.least("own", k), F.greatest("own", k)))
    with_main = F.transform(blocks, lambda k: meeting(False, F.col("own"), k))
    inside = F.transform(others, lambda k: meeting(False, k, F.col("block")))
    keys = F.when(F.col("outside"), F.concat(among, with_main)).otherwise(inside)
    met = large.join(placed.withColumn("own", own), "node")
    return met.select(F.explode(keys).alias("key"), "node", "shingles")


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, text)`` of all documents, and the rows without an id, numbered and stored, with their key.

    The key of a document is its id. Every row without one is a document of its own, after all ids.
    """
    unnamed = docs.filter(F.col("doc_id").isNull()).withColumn(ROW, F.monotonically_increasing_id())
    unnamed = stored(unnamed).withColumn(ROW, (F.col(ROW) + F.lit(AFTER_IDS)).cast(KEY))
    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").cast(KEY).alias("key"), "text")
    return named.union(unnamed.select(F.col(ROW).alias("key"), "text")), unnamed


def duplicate_keys(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(key, component)`` of the documents (key, text) that are near-duplicates of one with a lesser key.

    Texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, or
    others link them. Sets that share a key and have near sketches are candidates; every link
    is decided by the sets themselves, one of each distinct set: first the candidate links, then
    the pieces of a component of candidates that these leave apart.
    """
    def described(hashes: np.ndarray) -> tuple[int, int, bytes, bytes]:
        return set_name(hashes), len(hashes), *sketch(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [described(shingle_set(t.as_py())) for t in batch.column("text")]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds))],
                ["doc_id", "node", "size", "search", "print"],
            )

    docs = docs.withColumnRenamed("key", "doc_id")
    made = stored(docs.mapInArrow(run, f"doc_id {KEY}, node long, size long, search binary, print binary"))
    classes = stored(
        made.groupBy("node").agg(
            F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows"), *[F.first(c).alias(c) for c in ("size", "search", "print")]
        )
    )
    candidates = stored(linked(classes, each_key, SKETCH_BITS, SKETCH_WORDS, bucket))
    near = components(candidates)
    groups = classes.join(near, "node").select("node", "component", "size", "least_id")
    found = components(similar(docs, groups, candidates))
    named = stored(classes.join(found, "node", "left").select(
        "node", "least_id", "n_rows", F.coalesce("component", "node").alias("component")
    ))
    least = stored(
        named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    )
    answers = stored(spread_join(named, least, "component").select("node", "component_id", "n_rows"))
    return spread_join(made.select("doc_id", "node"), answers, "node", "n_rows").filter(
        F.col("doc_id") != F.col("component_id")
    ).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"))


def named_of(duplicates: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` of the duplicates that have an id; what they copy has one too, as ids come first."""
    return duplicates.filter(F.col("key") < F.lit(AFTER_IDS)).select(
        F.col("key").cast("long").alias("doc_id"), F.col("component").cast("long").alias("component_id")
    )


def duplicate_ids(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, component_id)`` of the documents that are near-duplicates of one with a lesser id.

    Rows without an id take part in the search, and may link others, but are not named here.
    """
    return named_of(duplicate_keys(keyed(docs)[0], bucket))


def deduplicated(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The documents that are not near-duplicates of one with a lesser key, with all their columns.

    Rows that share an id are one document, kept or dropped together. A row without an id is a document of its own
    after all that have one: it goes if it is a near-duplicate of one of those, and of a group of such rows alone
    one stays.
    """
    texts, unnamed = keyed(docs)
    dropped = stored(duplicate_keys(texts, bucket).distinct())
    kept = docs.join(named_of(dropped).select("doc_id").distinct(), "doc_id", "left_anti").filter(F.col("doc_id").isNotNull())
    alone = unnamed.join(dropped.select(F.col("key").alias(ROW)), ROW, "left_anti")
    return kept.select(docs.columns).union(alone.select(docs.columns))

"""Nearest neighbours by collision counting over single projections.

Vectors are projected on ``PROJECTIONS`` random directions, one value each. A block of vectors keeps the
values of a direction as a sorted array. A query opens a window around its own value in every
array, and vectors that lie in at least ``COLLISIONS`` of its windows are verified by their distance. Windows start narrow
and are widened level by level (virtual rehashing: the arrays stay, only the windows grow) until
they are as wide as the distance of the k-th best vector so far asks for. A vector at that distance or below falls into a
window with a probability of 0.68, so it misses the threshold once in some 800 times.

Search goes in two steps. First a query looks into the block it lies in, which with a sample of
``PIVOTS`` vectors bounds the distance of its k-th neighbour. Then it goes to those other blocks in which any vector could
collide often enough within that bound, as the ranges of the blocks' projections show.

Scale: blocks are pieces of at most about ``BLOCK`` vectors of the neighbourhoods of ``PIVOTS`` sampled
vectors, so a dense region is many blocks. Every block and every batch of at most ``QUERIES`` queries meet in
one task. Equal vectors are one, with the smallest ids, as many as a result can need, so a vector that a third of
all rows share costs a row per task. Results are the best of a block, merged with a limit on the
map side. Nothing but the sample (at most ``PIVOTS`` vectors) is sent to the driver.

Edge cases: vectors that are null, empty or zero, or hold null, NaN or infinite components take no part, nor do rows
without id; only vectors of one length are compared; rows of one id and vector are one, rows of one id with other vectors are
rows of their own; equal distances are ordered by id; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

NEAREST = 10
PROJECTIONS = 64
COLLISIONS = 32
HALF_WIDTH = 1.0  # of a window, in units of the distance searched: p = 0.683 at that distance
WIDEN = 1.5  # from level to level
LEVELS = 4
PIVOTS = 256
BLOCK = 2048
QUERIES = 2048
SUMMARIES = 4096
SEED = 5
KNOWN = 1e-9  # slack of bounds, relative


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, projections))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of an Arrow list array, all of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    off = vectors - query
    return np.sqrt((off * off).sum(1))


# --- Blocks ------------------------------------------------------------------------------------


class Block:
    """Vectors with a sorted array of values for each projection."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.vectors = vectors
        values = (vectors @ directions(vectors.shape[1], projections)).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, 1)

    def search(
        self, queries: np.ndarray, bounds: np.ndarray, k: int, collisions: int = COLLISIONS
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every query the places and distances of the ``k`` best vectors found, ties included.

        ``bounds`` are distances beyond which nothing is asked for.
        """
        n, m = len(self.vectors), len(self.sorted)
        if not np.isfinite(bounds).all():  # fewer than k vectors are known: windows that hold all
            limit = np.abs(self.sorted).max() + np.abs(queries).max() * np.abs(directions(queries.shape[1], m)).sum(0).max()
            bounds = np.where(np.isfinite(bounds), bounds, 2 * limit / HALF_WIDTH + 1)
        values = queries @ directions(queries.shape[1], m)
        levels = bounds[:, None] / WIDEN ** np.arange(LEVELS - 1, -1, -1)
        # The windows of all levels in every array: (level, query, projection).
        low, high = np.empty((2, LEVELS, len(queries), m), np.int64)
        for j in range(m):
            half = HALF_WIDTH * levels.T * (1 + KNOWN)
            low[:, :, j] = np.searchsorted(self.sorted[j], values[:, j] - half, "left")
            high[:, :, j] = np.searchsorted(self.sorted[j], values[:, j] + half, "right")
        for i, query in enumerate(queries):
            counts = np.zeros(n, np.int64)
            verified = np.zeros(n, bool)
            at, found = np.zeros(0, np.int64), np.zeros(0)
            bound, inner = bounds[i], None
            for level in range(LEVELS):
                a, b = low[level, i], high[level, i]
                if inner is None:
                    parts = [self.order[j, a[j] : b[j]] for j in range(m)]
                else:
                    parts = [self.order[j, a[j] : c] for j, c in enumerate(inner[0])]
                    parts += [self.order[j, d : b[j]] for j, d in enumerate(inner[1])]
                counts += np.bincount(np.concatenate(parts), minlength=n)
                inner = a, b
                fresh = np.flatnonzero((counts >= collisions) & ~verified)
                if len(fresh):
                    verified[fresh] = True
                    near = distances(self.vectors[fresh], query)
                    at, found = np.concatenate([at, fresh]), np.concatenate([found, near])
                    if len(found) >= k:
                        bound = min(bound, np.partition(found, k - 1)[k - 1])
                if levels[i, level] >= bound:
                    break
            near = found <= bound * (1 + KNOWN)
            yield at[near], found[near]


def best(places: np.ndarray, near: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The ``k`` first ``(distance, id)`` of the vectors found."""
    return sorted((d, x) for p, d in zip(places.tolist(), near.tolist(), strict=True) for x in ids[p])[:k]


def kth(rows: list[tuple[float, int]], k: int, bound: float) -> float:
    return min(bound, rows[k - 1][0]) if len(rows) >= k else bound


# --- Search ------------------------------------------------------------------------------------


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vec, dim)`` of the rows that take part."""
    vec = F.col(vector_col).cast("array<double>")
    sound = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return table.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & sound_or_false(sound)
        & F.exists("vec", lambda x: x != 0)
    ).withColumn("dim", F.size("vec"))


def sound_or_false(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``(node, dim, vec, ids)``: distinct vectors with their smallest ``k`` ids; node is the smallest of its rows' names."""
    first = Window.partitionBy("dim", "vec").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    return few.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def nearest(
    table: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, block: int = BLOCK, queries: int = QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found of every query row but itself.

    ``is_query`` is a column over ``id_col`` that marks the queries.
    """
    spark = table.sparkSession
    more = k + 1  # a query's own row is among those found
    rows = stored(usable(table, id_col, vector_col))
    unique = rows.dropDuplicates(["vec_id", "vec"])
    made = stored(classes(unique, more).withColumn("node", F.xxhash64("vec", "ids")))

    # Pivots: a bounded sample of the distinct vectors, as many as fill blocks.
    n = made.count()
    wanted = min(pivots, -(-n // block))
    sample = made.orderBy("node", F.element_at("ids", 1)).limit(wanted).select("dim", "vec", "ids").toArrow()
    by_dim: dict[int, np.ndarray] = {}
    ids_by_dim: dict[int, list] = {}
    for dim in set(sample["dim"].to_pylist()):
        of_dim = sample.filter(pa.compute.equal(sample["dim"], dim)).combine_chunks()
        by_dim[dim] = matrix(of_dim["vec"].combine_chunks() if hasattr(of_dim["vec"], "combine_chunks") else of_dim["vec"])
        ids_by_dim[dim] = of_dim["ids"].to_pylist()

    def near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest pivot, and a bound of the distance of the k-th neighbour, of each vector."""
        for batch in batches:
            dims = batch["dim"].to_numpy()
            pivot, bound = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.inf)
            for dim in set(dims.tolist()) & by_dim.keys():
                at = np.flatnonzero(dims == dim)
                vectors, known = matrix(batch["vec"].take(pa.array(at))), by_dim[dim]
                for i, v in zip(at.tolist(), vectors, strict=True):
                    off = distances(known, v)
                    pivot[i] = off.argmin()
                    rows = best(np.arange(len(known)), off, ids_by_dim[dim], more)
                    bound[i] = kth(rows, more, np.inf)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot), pa.array(bound)], [*batch.schema.names, "pivot", "bound"]
            )

    placed = made.mapInArrow(
        near_pivot, "dim int, vec array<double>, ids array<long>, node long, pivot int, bound double"
    )
    placed = stored(placed)
    pieces = placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    blocks = stored(
        placed.join(pieces, ["dim", "pivot"]).withColumn(
            "piece", F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int")
        ).drop("pieces")
    )
    key = ["dim", "pivot", "piece"]

    # A search for each distinct vector that a query has.
    asked = stored(unique.filter(is_query).select("vec_id", "dim", "vec").join(
        made.select("dim", "vec", "node"), ["dim", "vec"]
    ).select("vec_id", "node"))
    wanted_nodes = asked.select("node").distinct()
    searches = stored(blocks.join(wanted_nodes, "node").select(*key, "node", "vec", "bound"))

    def searched(right, left):
        held = Block(matrix(left["vec"].combine_chunks())) if left.num_rows and right.num_rows else None
        out: dict[str, list] = {"node": [], "found": [], "bound": []}
        if held is not None:
            ids = left["ids"].to_pylist()
            bounds = right["bound"].to_numpy()
            vectors = matrix(right["vec"].combine_chunks())
            for i in range(0, right.num_rows, 64):  # windows of so many queries are held at once
                part = held.search(vectors[i : i + 64], bounds[i : i + 64], more)
                for j, (at, near) in enumerate(part, i):
                    rows = best(at, near, ids, more)
                    out["node"].append(right["node"][j].as_py())
                    out["found"].append([{"score": d, "vec_id": x} for d, x in rows])
                    out["bound"].append(kth(rows, more, float(bounds[j])))
        return pa.table(
            [pa.array(out["node"], pa.int64()),
             pa.array(out["found"], pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))),
             pa.array(out["bound"], pa.float64())],
            names=["node", "found", "bound"],
        )

    result = "node long, found array<struct<score:double,vec_id:long>>, bound double"

    def met(asking: DataFrame) -> DataFrame:
        """Blocks and the queries that go to them (key, node, vec, bound), in batches of queries."""
        batches = asking.groupBy(*key).agg(F.ceil(F.count("*") / queries).cast("int").alias("batches"))
        batches = stored(batches)
        left = blocks.join(batches, key).select(
            *key, "vec", "ids", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch")
        )
        right = asking.join(batches, key).withColumn(
            "batch", F.pmod(F.xxhash64("node", F.lit(2)), F.col("batches")).cast("int")
        ).drop("batches")
        together = [*key, "batch"]
        return right.groupBy(*together).cogroup(left.groupBy(*together)).applyInArrow(searched, result)

    home = stored(met(searches))

    # Where else a vector could collide often enough: the ranges of every block's projections.
    def summed(part):
        made = Block(matrix(part["vec"].combine_chunks()))
        return pa.table(
            [*[part[c].slice(0, 1) for c in key], pa.array([made.sorted[:, 0].tolist()]), pa.array([made.sorted[:, -1].tolist()])],
            names=[*key, "low", "high"],
        )

    ranges = stored(
        blocks.groupBy(*key).applyInArrow(summed, "dim int, pivot int, piece int, low array<double>, high array<double>")
    )
    parts = max(1, -(-ranges.count() // SUMMARIES))
    batches = max(1, -(-searches.count() // SUMMARIES))

    def routed(asking, there):
        pairs: list[tuple[int, int]] = []
        if asking.num_rows and there.num_rows:
            low, high = matrix(there["low"].combine_chunks()), matrix(there["high"].combine_chunks())
            values = matrix(asking["vec"].combine_chunks())
            values = values @ directions(values.shape[1])
            own = [asking[c].to_numpy() for c in ("pivot", "piece")]
            blocks_at = [there[c].to_numpy() for c in ("pivot", "piece")]
            for i, (v, bound) in enumerate(zip(values, asking["bound"].to_numpy(), strict=True)):
                half = HALF_WIDTH * bound * (1 + KNOWN)
                reach = ((low <= v + half) & (high >= v - half)).sum(1) >= COLLISIONS
                reach &= (blocks_at[0] != own[0][i]) | (blocks_at[1] != own[1][i])
                pairs += [(i, x) for x in np.flatnonzero(reach).tolist()]
        i, x = (pa.array([p[c] for p in pairs], pa.int64()) for c in (0, 1))
        return pa.table(
            [*[there[c].take(x) for c in key], *[asking[c].take(i) for c in ("node", "vec", "bound")]],
            names=[*key, "node", "vec", "bound"],
        )

    bounded = searches.drop("bound").join(home.select("node", "bound"), "node")
    asking = bounded.select(
        *key, "node", "vec", "bound", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(batches)).cast("int").alias("a"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("b"),
    )
    there = ranges.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("a"),
        F.pmod(F.xxhash64("pivot", "piece", F.lit(4)), F.lit(parts)).cast("int").alias("b"),
    )
    together = ["dim", "a", "b"]
    others = stored(
        asking.groupBy(*together).cogroup(there.groupBy(*together)).applyInArrow(
            routed, "dim int, pivot int, piece int, node long, vec array<double>, bound double"
        )
    )
    away = home.select("node", "found").union(met(others).select("node", "found"))
    order = Window.partitionBy("node").orderBy("score", "vec_id")
    merged = away.select("node", F.explode("found").alias("f")).select("node", "f.score", "f.vec_id").withColumn(
        "place", F.row_number().over(order)
    ).filter(F.col("place") <= more)
    lists = stored(
        merged.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    )
    own_out = asked.withColumnRenamed("vec_id", "query_id").join(lists, "node").select(
        "query_id",
        F.slice(
            F.filter("found", lambda f: (f["vec_id"] != F.col("query_id")) | (f["score"] > 0)), 1, k
        ).alias("found"),
    )
    return own_out.select("query_id", F.posexplode("found").alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", "f.score"
    )

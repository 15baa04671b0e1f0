"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every source is a queue of its documents in a shuffled order, repeated up to ``max_repeats``
times. A document's virtual finish time is the words its source has sent once it is through,
divided by the source's target. All queues are merged by finish time and cut where the words
reach the total budget.

Scale: only (row, source, size) is kept of a document. Both orders, that of a queue and that of the merged
queues, are ranges of their keys, sorted within, so a source with a third of all rows is spread evenly.
Sums within a range are windows; those of all ranges before it come from one row per range and
source. A range's last key is the row's number, so repeated rows are spread, too. Of the copies, those
in coarse bins of finish time after the one in which the budget ends are not sorted.
Only tables of sources, bins and ranges are ordered in one task.

Edge cases: a null or empty text has size 0 and takes nothing; a null source is a source of its
own, the last; a null id is an ordinary id; identical rows are rows of their own, one after another in the
queue; no rows give no rows; other columns are ignored, and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content, stored, words

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
TICKS = float(1 << 32)  # resolution of a virtual finish time
LAST_TICK = 1 << 60
COARSE = 24  # bits of a finish time that a coarse bin leaves out
LAST_BIN = 4096
PLACE_BITS = 33  # of ``monotonically_increasing_id``, the bits that count within a partition
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``target`` words of every source; ``sizes`` has (queue, source, source_size).

    The targets share the sum of all sizes by weight; no target is above ``max_repeats`` times
    its source, and what that cuts off is shared again by weight. Sources are taken by the ratio
    of cap and weight: they are capped until the level that the rest would get is below the ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "queue").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    weighted = sizes.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * max_repeats
    )
    levels = (
        weighted.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn(
            "level",
            (F.col("total") - F.col("caps_before"))
            / (F.col("weights") - F.col("weights_before")),
        )
        .withColumn("capped", F.col("ratio") <= F.col("level"))
    )
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * level
    )
    return levels.select("queue", "source_size", target.alias("target"))


def units(docs: DataFrame, row: Column) -> DataFrame:
    """What the queues know of every document; ``row`` numbers the rows."""
    text = content(F.col("text"))
    queue = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    order = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select(
        row.alias("row"), "doc_id", "source", queue.alias("queue"), order.alias("shuffled"),
        F.size(words(text)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"),
    )


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order of ``keys``, with the number of their range and their place in it.

    They are stored, so that places stay as they are. The keys tell all rows apart, so ranges are even.
    """
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", place)
    part = F.shiftright("at", PLACE_BITS)
    return stored(ordered).select(
        *df.columns, part.alias("part"), (F.col("at") - F.shiftleft(part, PLACE_BITS)).alias("place")
    )


def queued(rows: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``units`` with ``sent``: the words of their source up to and with them, in shuffled order."""
    ordered = ranged(rows, "queue", "shuffled", "doc_id", "size", "text_hash", "row")
    sums = stored(ordered.groupBy("queue", "source", "part").agg(F.sum("size").alias("in_part")))
    in_order = Window.partitionBy("queue").orderBy("part")
    starts = sums.select(
        "queue", "part", (F.sum("in_part").over(in_order) - F.col("in_part")).alias("before")
    )
    sizes = sums.groupBy("queue", "source").agg(F.sum("in_part").alias("source_size"))
    starts = starts.join(source_targets(sizes, weights, max_repeats), "queue")
    inside = (
        Window.partitionBy("queue", "part").orderBy("place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = ordered.withColumn("within", F.sum("size").over(inside))
    return within.join(starts, ["queue", "part"]).select(
        "row", "doc_id", "source", "queue", "size", "source_size", "target",
        (F.col("before") + F.col("within")).alias("sent"),
    )


def merged(queue: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The copies that the mix takes, as (row, position): all queues by finish time, up to the budget.

    The budget is the words of all documents. The first copy that would exceed it ends the mix.
    """
    sent = F.col("sent") + F.col("pass") * F.col("source_size")
    tick = F.floor(sent.cast("double") / F.col("target") * TICKS).cast("long")
    copies = (
        queue.filter(F.col("size") > 0)
        .withColumn("pass", F.explode(F.array(*[F.lit(r).cast("long") for r in range(max_repeats)])))
        .select("row", "queue", "size", sent.alias("sent"), F.least(tick, F.lit(LAST_TICK)).alias("tick"))
        .withColumn("bin", F.least(F.shiftright("tick", COARSE), F.lit(LAST_BIN)))
    )
    budget = queue.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = copies.groupBy("bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("bin"))
    last_bin = bins.withColumn("upto", upto).filter(F.col("upto") > budget).agg(F.min("bin")).first()[0]
    if last_bin is not None:
        copies = copies.filter(F.col("bin") <= last_bin)
    ordered = ranged(copies.drop("bin"), "tick", "queue", "sent")
    sums = {
        r.part: (r.n, r.words)
        for r in ordered.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()
    }
    starts, before, left, cut = [], 1, budget, None
    for part in range(max(sums, default=-1) + 1):
        n, size = sums.get(part, (0, 0))
        starts.append(before)
        if size > left:
            cut = part
            break
        before, left = before + n, left - size
    if cut is not None:
        running = F.sum("size").over(Window.partitionBy("part").orderBy("place"))
        over = ordered.filter(F.col("part") == cut).withColumn("upto", running)
        end = over.filter(F.col("upto") > left).agg(F.min("place")).first()[0]
        ordered = ordered.filter(
            (F.col("part") < cut) | ((F.col("part") == cut) & (F.col("place") < end))
        )
    start = F.get(F.split(F.lit(",".join(map(str, starts or [1]))), ",").cast("array<bigint>"), F.col("part").cast("int"))
    return ordered.select("row", (start + F.col("place")).alias("position"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Every document with its size, its source's size and target, and what the mix takes of it.

    ``copies`` is how often it is taken, ``position`` (from 1) where the first of them is in the mix.
    """
    rows = stored(units(docs, F.monotonically_increasing_id()))
    queue = stored(queued(rows, weights, max_repeats))
    taken = merged(queue, max_repeats).groupBy("row").agg(
        F.count("*").alias("copies"), F.min("position").alias("position")
    )
    return queue.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("copies", F.lit(0)).alias("copies"), "position",
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The copies of the mix in its order, with all columns of their documents."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("document")))
    known = rows.select("row", "document.doc_id", "document.source", "document.text")
    queue = stored(queued(units(known, F.col("row")), weights, max_repeats))
    taken = rows.join(merged(queue, max_repeats), "row")
    return taken.orderBy("position").select("document.*")

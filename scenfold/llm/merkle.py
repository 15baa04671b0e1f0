"""Merkle manifest of a data set: a hash tree per group, one over the groups, and every row's proof.

A row is a leaf. Within a tree, every two consecutive nodes become their hash, the last one alone if they are
odd, until one remains. The trees are built by a rollup of ranks: a leaf's rank is written in digits of base
``BASE``, and the digits are grouped away one after the other, each time nesting the structs of the
nodes below in the struct of their common node, with the hashes beside each. What is left is one
row per block of ``BASE ** DIGITS`` leaves; nested transforms and an explode turn it into proofs, so
no leaf is joined with its siblings. The blocks of a tree are the leaves of the next rollup, by the same function.

Scale: a text is hashed where it is read, and only digests move: once to sorted ranges, once to
blocks. Ranges are cut by samples of (group, id, hash), so a group with most of the rows is spread over many; ranks are
positions in the ranges plus what earlier ranges hold. A block holds at most 4,096 leaves,
whatever the size of its group; above the blocks are a 4,096th of the rows, joined with their own
path by (group, block). A billion leaves take three rollups.

Edge cases: a null column is ``-``, an empty text ``0:``; a null id sorts first; rows of one id are in the
order of their leaves, repeated rows are leaves of their own; a null group is a group, the first; a single leaf is its
group's root; no rows give no rows; only the named columns count, others are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_value

BASE_BITS = 4
DIGITS = 3
BASE = 1 << BASE_BITS
BLOCK_BITS = BASE_BITS * DIGITS
POSITION_BITS = 33  # of a row within its partition, as monotonically_increasing_id has it
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TREE = ("is_named", "name")  # a tree's group: whether it is not null, and its value

STEP = "struct<before:string,after:string>"  # what a node is hashed with: siblings before and after it


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column], names=COLUMNS) -> Column:
    return digest(*[field(columns[name]) for name in names])


def levels_of(size: Column) -> Column:
    """Rounds of pairing until one of ``size`` nodes remains."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


# --- Ranks -------------------------------------------------------------------------------------


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` within each tree by ``order``, from 0, and ``levels`` of the tree; rows are stored."""
    keys = [*TREE, *order]
    placed = stored(
        rows.withColumn("scanned", F.monotonically_increasing_id())  # deals equal rows out
        .repartitionByRange(*keys, "scanned")
        .drop("scanned")
        .sortWithinPartitions(*keys)
        .withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", POSITION_BITS)
    sizes = placed.groupBy(*TREE, part.alias("part")).agg(
        F.count("*").alias("n"), F.min("place").alias("first")
    )
    of_tree = Window.partitionBy(*TREE)
    starts = stored(
        sizes.withColumn("before", F.sum("n").over(of_tree.orderBy("part")) - F.col("n"))
        .withColumn("levels", levels_of(F.sum("n").over(of_tree)))
        .select(*TREE, "part", "first", "before", "levels")
    )
    return placed.withColumn("part", part).join(starts, [*TREE, "part"]).select(
        *rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("rank"), "levels"
    )


# --- Rollup ------------------------------------------------------------------------------------


def paired(hashes: Column) -> Column:
    """The nodes above an array of nodes."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(2)),
        lambda i: F.sha2(F.concat(F.get(hashes, i), F.coalesce(F.get(hashes, i + 1), F.lit(""))), 256),
    )


def sibling_step(hashes: Column, at: Column) -> Column:
    other = F.coalesce(F.get(hashes, at.bitwiseXOR(F.lit(1))), F.lit(""))
    right = at.bitwiseAND(F.lit(1)) == 1
    return F.struct(
        F.when(right, other).otherwise("").alias("before"), F.when(right, "").otherwise(other).alias("after")
    )


def folded(kids: Column, first_level: int, levels: Column) -> Column:
    """``(h, kids)``: the hash of up to ``BASE`` sibling nodes, and the nodes with their path to it.

    Rounds at and above ``levels`` are none: only one node is left there.
    """
    def climb(hashes: Column, k: int, steps: list) -> Column:
        if k == BASE_BITS:
            def with_path(kid: Column, i: Column) -> Column:
                path = [
                    F.when(levels > first_level + j, sibling_step(below, F.shiftright(i, j)))
                    for j, below in enumerate(steps)
                ]
                return F.struct(kid.alias("node"), F.array_compact(F.array(*path)).alias("path"))

            return F.struct(F.get(hashes, 0).alias("h"), F.transform(kids, with_path).alias("kids"))
        above = F.when(levels > first_level + k, paired(hashes)).otherwise(hashes)
        return with_value(above, lambda up: climb(up, k + 1, [*steps, hashes]))

    return with_value(F.transform(kids, lambda kid: kid["h"]), lambda hashes: climb(hashes, 0, []))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """``(tree, block, levels, h, kids)``: a row for each block of ``nodes`` (tree, rank, levels, h, row).

    The kids of a block are nested ``DIGITS`` deep; each has ``node`` and its ``path`` in its group.
    """
    digits = [
        F.shiftright("rank", BASE_BITS * k).bitwiseAND(F.lit(BASE - 1)).cast("int").alias(f"d{k}")
        for k in range(DIGITS)
    ]
    kids = nodes.select(
        *TREE, F.shiftright("rank", BLOCK_BITS).alias("block"), "levels", *digits,
        F.struct("h", "row").alias("node"),
    ).repartition(*TREE, "block")
    for k in range(DIGITS):
        left = [*TREE, "block", *[f"d{j}" for j in range(k + 1, DIGITS)]]
        in_order = F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node"))), lambda x: x["node"]
        )
        kids = kids.groupBy(*left).agg(F.first("levels").alias("levels"), in_order.alias("kids")).select(
            *left, "levels", folded(F.col("kids"), BASE_BITS * k, F.col("levels")).alias("node")
        )
    return kids.select(*TREE, "block", "levels", "node.h", "node.kids")


def paths(nodes: DataFrame) -> DataFrame:
    """``(tree, row, path, root)`` of every node: the steps from its hash to its tree's root.

    ``nodes`` has a tree's columns, ``rank``, ``levels``, the hash ``h`` and a struct ``row``.
    """
    blocks = stored(rolled_up(nodes))

    def opened(kids: Column, depth: int, above: Column) -> Column:
        if depth == 1:
            return F.transform(
                kids, lambda kid: F.struct(kid["node"]["row"].alias("row"), F.concat(kid["path"], above).alias("path"))
            )
        return F.flatten(
            F.transform(kids, lambda kid: opened(kid["node"]["kids"], depth - 1, F.concat(kid["path"], above)))
        )

    if blocks.filter("block > 0").isEmpty():  # every tree is one block
        whole = blocks.withColumn("top", F.array().cast(f"array<{STEP}>")).withColumn("root", F.col("h"))
    else:
        upper = paths(
            blocks.select(
                *TREE, F.col("block").alias("rank"),
                F.greatest(F.col("levels") - BLOCK_BITS, F.lit(0)).alias("levels"),
                "h", F.struct(F.col("block").alias("at")).alias("row"),
            )
        )
        upper = upper.select(*TREE, F.col("row.at").alias("block"), F.col("path").alias("top"), "root")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*TREE, "block")]
        whole = blocks.alias("a").join(upper.alias("b"), same).select("a.*", "b.top", "b.root")
    kid = F.explode(opened(F.col("kids"), DIGITS, F.col("top")))
    return whole.select(*TREE, kid.alias("kid"), "root").select(*TREE, "kid.row", "kid.path", "root")


def refolded(start: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path give."""
    return F.aggregate(path, start, lambda h, s: digest(s["before"], h, s["after"]))


# --- Manifest ----------------------------------------------------------------------------------


def manifest(docs: DataFrame, checked: Column, group: str = "lang", names=COLUMNS) -> DataFrame:
    """Every row's id, ``leaf``, ``subroot``, ``root``, ``path`` (siblings from leaf to root) and ``checked``.

    ``checked`` is a column of digests over the columns of ``docs`` that is carried along, as the
    leaf that a row has at another time, to be held against its proof.
    """
    own = {name: F.col(name) for name in names}
    leaves = stored(docs.select(  # ranges are sampled first, so texts would be hashed twice
        F.col(group).isNotNull().alias("is_named"), F.coalesce(F.col(group), F.lit("")).alias("name"),
        "doc_id", leaf(own, names).alias("leaf"), checked.alias("checked"),
    ))
    rows = ranked(leaves, ["doc_id", "leaf"]).select(
        *TREE, "rank", "levels", F.col("leaf").alias("h"), F.struct("doc_id", "leaf", "checked").alias("row")
    )
    within = stored(paths(rows))
    groups = within.groupBy(*TREE).agg(F.first("root").alias("subroot"))
    groups = groups.select(
        F.lit(True).alias("is_named"), F.lit("").alias("name"),
        F.col("is_named").alias("group_named"), F.col("name").alias("group_name"), "subroot",
    )
    tops = paths(
        ranked(groups, ["group_named", "group_name"]).select(
            *TREE, "rank", "levels", F.col("subroot").alias("h"),
            F.struct("group_named", "group_name").alias("row"),
        )
    ).select(
        F.col("row.group_named").alias("is_named"), F.col("row.group_name").alias("name"),
        F.col("path").alias("top"), F.col("root").alias("all"),
    )
    tops = stored(tops)
    return within.join(tops, list(TREE)).select(
        "row.doc_id", "row.leaf", "row.checked", F.col("root").alias("subroot"), F.col("all").alias("root"),
        F.concat("path", "top").alias("path"),
    )


def proven(listed: DataFrame) -> DataFrame:
    """A manifest with ``proof_sha256``, ``folded_root`` of what was checked, and ``verified``."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return listed.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        refolded(F.col("checked"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def with_added_chars(every: int = 7) -> Column:
    """The leaf of a row if 1 were added to its n_chars, where ``every`` divides the id's crc32."""
    own = {name: F.col(name) for name in COLUMNS}
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    changed = own | {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return leaf(changed)

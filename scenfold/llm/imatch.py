"""I-Match fingerprints over randomised lexicons, in DataFrame operations alone.

The terms of a text are its distinct words, ASCII letters in lower case. Terms in at least
1/``RARE`` and at most 1/``COMMON`` of the documents (a band of inverse document frequency) form the
lexicon. ``SUBSETS`` random subsets of it, of four rates, are fixed by a hash of each term. A text's fingerprint has a
part per subset: a hash of the text's sorted terms in it. Two fingerprints are as alike as the
share of equal parts among those that are not empty in both. Rare subsets survive edits, dense ones tell texts
apart. A text with no term in any subset is hashed as a whole instead.

Scale: document frequencies are summed map-side. The lexicon has at most (mean distinct terms of
a document) x ``RARE`` terms, as every one of them is in N/``RARE`` documents. Up to
``MAX_LEXICON`` terms it is one constant hash table, looked up where a text is read, and fingerprints
need no shuffle. A larger one is joined with the distinct terms of each distinct text, with the same
fingerprints: terms in many documents, and texts with many copies, are hot keys that are broadcast
(``common.spread_join``). Editing a text with its successor's words moves each text once, into
slices between sampled pairs of id and text hash, so equal or null ids are spread too; a slice's first
text also goes to the slice before it. Only rows equal in id and text stay together.

Edge cases: a null text is empty; a null id sorts first; equal ids are ordered by a hash of their text; a
single document follows itself; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content, lower_ascii, spread_join, stored, with_value, words

RARE = 200
COMMON = 5
# Hexadecimal digits of a term's hash, the number of values of them that are in a subset, subsets.
RATES = ((1, 2, 4), (2, 8, 6), (2, 4, 14))
SUBSETS = sum(n for _, _, n in RATES)
EMPTY = "00000000"
MAX_LEXICON = 100_000  # terms in a constant table; more are joined
SLICE_DOCS = 4000
MAX_SLICES = 100_000
LOWEST = -(1 << 63)


def terms(text: Column) -> Column:
    return F.array_distinct(words(lower_ascii(content(text))))


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """``(term, df, banded)`` of the terms in at least 1/``rare`` of the documents.

    ``banded`` terms are the lexicon; the others, in more than 1/``common`` of the documents, are
    at most ``common`` times as many as a document has distinct terms on average.
    """
    total = docs.count()
    return (
        docs.select(F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .filter(F.col("df") * rare >= total)
        .withColumn("banded", F.col("df") * common <= total)
    )


def subset_mask(term: Column) -> Column:
    """One bit per subset that the term belongs to."""
    mask, j = F.lit(0).cast("long"), 0
    for digits, chosen, subsets in RATES:
        for _ in range(subsets):
            digest = F.substring(F.md5(F.concat(F.lit(f"{j}:"), term)), 1, digits)
            inside = F.conv(digest, 16, 10).cast("int") < chosen
            mask = mask + F.when(inside, F.lit(1 << j).cast("long")).otherwise(0)
            j += 1
    return mask


MASK_BITS = 24


def packed_term(term: Column) -> Column:
    """A term's code and the subsets it belongs to."""
    code = F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("long")
    return F.shiftleft(code, MASK_BITS) + subset_mask(term)


def lookup_table(band: DataFrame) -> Column:
    """The lexicon as a constant hash table.

    ``starts`` has, for every slot, the place of its first entry; ``keys`` the terms' hashes and
    ``packed`` their codes and subset masks.
    """
    slots = 1 << max(4, (2 * band.count()).bit_length())
    entries = band.select(
        F.pmod(F.xxhash64("term"), F.lit(slots)).alias("slot"),
        F.xxhash64("term").alias("key"),
        packed_term(F.col("term")).alias("packed"),
    )
    rows = entries.orderBy("slot", "key", "packed").toArrow().to_pydict()
    starts, filled = [0] * (slots + 1), rows["slot"]
    for slot in filled:
        starts[slot + 1] += 1
    for slot in range(slots):
        starts[slot + 1] += starts[slot]

    def constant(values: list[int], kind: str) -> Column:
        listed = F.split(F.lit(",".join(map(str, values or [0]))), ",")
        return listed.cast(f"array<{kind}>")

    return F.struct(
        constant(starts, "int").alias("starts"),
        constant(rows["key"], "bigint").alias("keys"),
        constant(rows["packed"], "bigint").alias("packed"),
    )


def looked_up(text: Column, table: Column) -> Column:
    """The packed terms of a text that the lexicon's table has, sorted."""
    none = F.array().cast("array<int>")

    def within(fixed: Column) -> Column:
        starts, keys, packed = fixed["starts"], fixed["keys"], fixed["packed"]

        def places(h: Column) -> Column:
            slot = F.pmod(h, F.size(starts) - 1).cast("int")
            return with_value(
                slot,
                lambda s: F.when(
                    F.get(starts, s + 1) > F.get(starts, s),
                    F.filter(
                        F.sequence(F.get(starts, s), F.get(starts, s + 1) - 1),
                        lambda i: F.get(keys, i) == h,
                    ),
                ).otherwise(none),
            )

        hashes = F.transform(terms(text), lambda term: F.xxhash64(term))
        found = F.flatten(F.transform(hashes, places))
        return F.sort_array(F.transform(found, lambda i: F.get(packed, i)))

    return with_value(table, within)


def subset_parts(packed: Column) -> Column:
    """A part per subset, ``EMPTY`` where it has none of a text's packed terms."""
    def part(found: Column, j: int) -> Column:
        kept = F.filter(found, lambda e: e.bitwiseAND(F.lit(1 << j).cast("long")) != 0)
        codes = F.transform(kept, lambda e: F.shiftright(e, MASK_BITS).cast("string"))
        return F.when(F.size(kept) == 0, EMPTY).otherwise(
            F.substring(F.md5(F.concat_ws(",", codes)), 1, 8)
        )

    return with_value(packed, lambda f: F.array(*[part(f, j) for j in range(SUBSETS)]))


def or_whole(parts: Column, text: Column) -> Column:
    """The parts, or those of the whole text where all are empty."""
    def filled(found: Column) -> Column:
        plain = F.substring(F.md5(lower_ascii(content(text))), 1, 8)
        return F.when(
            F.forall(found, lambda p: p == EMPTY), F.array_repeat(plain, SUBSETS)
        ).otherwise(found)

    return with_value(parts, filled)


def with_joined_parts(rows: DataFrame, text: str, name: str, known: DataFrame) -> DataFrame:
    """Rows with the parts of their fingerprint, by a join with ``lexicon``.

    Terms above the band are few and go first, so no term left is in most texts. Equal texts have
    one digest; their terms are gathered as sets, so copies are combined map-side.
    """
    digest = F.unhex(F.md5(content(F.col(text))))
    held = rows.select(digest.alias("digest"), F.explode(terms(F.col(text))).alias("term")).join(
        F.broadcast(known.filter(~F.col("banded")).select("term")), "term", "left_anti"
    )
    band = known.filter("banded").select(
        "term", packed_term(F.col("term")).alias("packed"), F.col("df").alias("n")
    )
    pair = F.struct(F.xxhash64("term").alias("key"), "packed")
    found = spread_join(held, band, "term").groupBy("digest").agg(F.collect_set(pair).alias("pairs"))
    packed = F.sort_array(
        F.coalesce(F.transform("pairs", lambda x: x["packed"]), F.array().cast("array<bigint>"))
    )
    copies = rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"))
    answers = stored(
        copies.join(found, "digest", "left").select("digest", "n", subset_parts(packed).alias("parts"))
    )
    named = rows.select(F.struct("*").alias("row"), digest.alias("digest"))
    return spread_join(named, answers, "digest").select(
        "row.*", or_whole(F.col("parts"), F.col(f"row.{text}")).alias(name)
    )


def likeness(a: Column, b: Column) -> Column:
    """The share of equal parts among those that are not empty in both fingerprints."""
    equal = F.zip_with(a, b, lambda x, y: (x == y) & (x != EMPTY))
    filled = F.zip_with(a, b, lambda x, y: (x != EMPTY) | (y != EMPTY))
    n = F.size(F.filter(filled, lambda x: x))
    return F.when(n > 0, F.size(F.filter(equal, lambda x: x)) / n).otherwise(1.0)


def with_successors(docs: DataFrame, extra: list[str], slice_docs: int = SLICE_DOCS) -> DataFrame:
    """Documents with ``next_text`` and ``next_<extra>``: those of the document next by id.

    The last document is followed by the first.
    """
    ranked = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    keyed = docs.withColumn("id_key", ranked).withColumn("text_hash", F.xxhash64(content(F.col("text"))))
    every = max(slice_docs, docs.count() // MAX_SLICES)
    pairs = keyed.select("id_key", "text_hash").filter(
        F.pmod(F.xxhash64("id_key", "text_hash", F.lit(7)), F.lit(every)) == 0
    )
    bounds = pairs.distinct().orderBy("id_key", "text_hash").collect()

    def sliced(fixed: Column) -> Column:
        """The number of bounds at or below a row's pair, by binary search."""
        def below(at: Column) -> Column:
            return (at["id_key"] < F.col("id_key")) | (
                (at["id_key"] == F.col("id_key")) & (at["text_hash"] <= F.col("text_hash"))
            )

        place = F.lit(0)
        for step in (1 << k for k in reversed(range(len(bounds).bit_length()))):
            place = with_value(
                place,
                lambda p, step=step: F.when(
                    below(F.get(fixed, p + (step - 1))), p + step
                ).otherwise(p),
            )
        return place

    if bounds:
        ids, hashes = (
            F.split(F.lit(",".join(map(str, column))), ",").cast("array<bigint>")
            for column in zip(*bounds, strict=True)
        )
        constant = F.arrays_zip(ids.alias("id_key"), hashes.alias("text_hash"))
        keyed = keyed.withColumn("slice", with_value(constant, sliced))
    else:
        keyed = keyed.withColumn("slice", F.lit(0))
    # The first document of every slice also ends the slice before it, as its last successor.
    heads = stored(
        keyed.groupBy("slice").agg(F.min(F.struct("id_key", "text_hash")).alias("head"))
    )
    before = F.coalesce(
        F.lag("slice").over(Window.orderBy("slice")), F.max("slice").over(Window.partitionBy())
    )
    heads = heads.select(
        F.col("head.id_key").alias("id_key"), F.col("head.text_hash").alias("text_hash"),
        before.alias("slice_before"),
    )
    both = keyed.join(F.broadcast(heads), ["id_key", "text_hash"], "left").select(
        "doc_id", "text", *extra, "id_key", "text_hash",
        F.explode(
            F.when(
                F.col("slice_before").isNull(),
                F.array(F.struct(F.col("slice").alias("slice"), F.lit(False).alias("guest"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("slice").alias("slice"), F.lit(False).alias("guest")),
                    F.struct(F.col("slice_before").alias("slice"), F.lit(True).alias("guest")),
                )
            )
        ).alias("to"),
    ).select("*", "to.slice", "to.guest").drop("to")
    inside = Window.partitionBy("slice").orderBy("guest", "id_key", "text_hash")
    return both.select(
        "doc_id", "text", *extra, "guest",
        F.lead("text").over(inside).alias("next_text"),
        *[F.lead(c).over(inside).alias(f"next_{c}") for c in extra],
    ).filter(~F.col("guest")).drop("guest")


def fingerprinter(
    docs: DataFrame, rare: int = RARE, common: int = COMMON, max_table: int = MAX_LEXICON
) -> Callable[[DataFrame, str, str], DataFrame]:
    """What adds to rows, in a named column, the fingerprint parts of a column of texts.

    The lexicon is that of ``docs``: a constant table of up to ``max_table`` terms, else joined.
    """
    known = stored(lexicon(docs, rare, common))
    band = known.filter("banded")
    if band.count() > max_table:
        return lambda rows, text, name: with_joined_parts(stored(rows), text, name, known)
    table = lookup_table(band)

    def added(rows: DataFrame, text: str, name: str) -> DataFrame:
        parts = subset_parts(looked_up(F.col(text), table))
        return rows.withColumn(name, or_whole(parts, F.col(text)))

    return added


def edited(
    docs: DataFrame, rare: int = RARE, common: int = COMMON, max_table: int = MAX_LEXICON
) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and how alike they are."""
    plain = docs.select("doc_id", content(F.col("text")).alias("text"))
    with_parts = fingerprinter(plain, rare, common, max_table)
    rows = with_successors(with_parts(plain, "text", "parts"), ["parts"])
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    text = F.concat(
        F.substring("text", F.lit(1), n_chars - half), F.substring("next_text", F.lit(1), half)
    )
    rows = with_parts(
        rows.select(
            "doc_id", n_chars.cast("long").alias("n_chars"), text.alias("edited_text"), "parts",
            "next_parts",
        ),
        "edited_text", "edited_parts",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_text", "parts", "edited_parts",
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )

"""Quality rules: base counts of a text, and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials are counted, one over
trusted documents and one over the whole corpus; a document's score is the mean, over its n-grams,
of the logarithm of the ratio of the two. A document passes if its score reaches the threshold.

Scale: one pass counts the buckets (partial sums of at most ``BUCKETS`` rows a task), one scores.
The scores need no shuffle: the bucket weights are one array of fixed length, and a text is read
in the task that scans it, so neither long texts nor hot sources gather anywhere. Weights are whole numbers
(2^-20 of a unit), so sums do not depend on order. The ids of trusted documents are broadcast
only up to ``BROADCAST_IDS`` of them, otherwise joined.

Edge cases: a null text has no words and fails the base rules; a text with words but no trusted
documents to compare with scores 0; repeated rows get the same verdict; a repeated label counts
once; a label is trusted if any of its rows is; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, content, stored, with_value, words

BUCKETS = 1 << 17
SMOOTHING = 1.0
UNIT = 1 << 20
THRESHOLD = -0.12
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
BROADCAST_IDS = 1_000_000
SYMBOLS = "[^#*$%&|<>]+"  # what is not a symbol
WORD_CHAR = "[^ \\t-\\r]"


def repeated_words(w: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur more than once in the text.

    ``w`` must be a lambda variable. Windows are compared by 64-bit hash; sorting them brings equal
    ones side by side, so the cost is n log n for a text of any length.
    """
    def covered(ordered: Column) -> Column:
        def start(x, i):
            same_before = F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
            same_after = F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
            return F.when(same_before | same_after, x["p"])

        starts = F.array_compact(F.transform(ordered, start))
        return F.size(
            F.array_distinct(
                F.flatten(F.transform(starts, lambda p: F.array(*[p + k for k in range(width)])))
            )
        )

    def counted(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            with_value(F.sort_array(pairs), covered)
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
    )
    return F.when(F.size(w) <= width, 0).otherwise(with_value(windows, counted)).cast("long")


def line_counts(text: Column) -> dict[str, Column]:
    """The counts of the base rules that words are not needed for, by name."""
    plain = content(text)
    lines = F.filter(F.split(plain, "\n"), lambda line: line.rlike(WORD_CHAR))
    return {
        "word_chars": F.length(F.regexp_replace(plain, SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(plain, SYMBOLS, "")).cast("long"),
        "n_dup_lines": with_value(
            lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))
        ).cast("long"),
    }


def base_counts(text: Column) -> dict[str, Column]:
    """The counts of the base rules, by name."""
    return {
        "n_words": F.size(words(text)).cast("long"),
        **line_counts(text),
        "n_repeat_words": with_value(words(text), repeated_words),
    }


def ngram_buckets(w: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and pairs of neighbouring words of a lambda variable."""
    single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(w) - 1),
        lambda i: F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i)), F.lit(buckets)).cast("int"),
    )
    return F.when(F.size(w) < 2, single).otherwise(F.concat(single, pairs))


def ratio_weights(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> DataFrame:
    """``(bucket, weight)`` for every bucket; ``trusted`` holds ids, one column ``trusted_id``."""
    ids = trusted.filter(F.col("trusted_id").isNotNull()).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select("doc_id", "text").join(
        F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("trusted_id"), "left"
    )
    counts = (
        marked.select(
            F.col("trusted_id").isNotNull().cast("long").alias("is_trusted"),
            F.explode(with_value(words(F.col("text")), lambda w: ngram_buckets(w, buckets))).alias(
                "bucket"
            ),
        )
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("is_trusted").alias("trusted"))
    )
    counts = stored(counts)  # at most a row per bucket; read twice
    every = (
        docs.sparkSession.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(counts, "bucket", "left")
        .fillna(0, ["raw", "trusted"])
    )
    totals = counts.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"),
        F.coalesce(F.sum("trusted"), F.lit(0)).alias("all_trusted"),
    ).first()
    if not totals.all_trusted:
        return every.select("bucket", F.lit(0).cast("long").alias("weight"))
    spread = smoothing * buckets
    ratio = ((F.col("trusted") + smoothing) / (totals.all_trusted + spread)) / (
        (F.col("raw") + smoothing) / (totals.all_raw + spread)
    )
    return every.select("bucket", F.round(F.log(ratio) * UNIT).cast("long").alias("weight"))


def judged(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """Base counts, ``base_failed``, ``log_ratio`` (null without words) and ``kept`` by document."""
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "weight")))
    listed = F.concat_ws(",", F.transform(ordered, lambda x: x["weight"].cast("string")))
    weights = ratio_weights(docs, trusted, buckets, smoothing).agg(listed).first()[0]
    weights = F.split(F.lit(weights), ",").cast("array<bigint>")  # folded into one literal

    def mean_weight(values: Column, w: Column) -> Column:
        def over(found: Column) -> Column:
            total = F.aggregate(
                found, F.lit(0).cast("long"), lambda acc, b: acc + F.get(values, b)
            )
            return F.when(F.size(found) > 0, total / F.size(found) / UNIT)

        return with_value(ngram_buckets(w, buckets), over)

    def of_words(values: Column) -> Column:
        """What is made of a text's words, which are split once."""
        return with_value(
            words(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                repeated_words(w).alias("n_repeat_words"),
                mean_weight(values, w).alias("log_ratio"),
            ),
        )

    counted = docs.select(
        "doc_id",
        with_value(weights, of_words).alias("by_words"),
        *[c.alias(name) for name, c in line_counts(F.col("text")).items()],
    ).select(
        "doc_id", "by_words.n_words", "word_chars", "n_symbols", "n_dup_lines",
        "by_words.n_repeat_words", "by_words.log_ratio",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("log_ratio") >= threshold, F.lit(True))
    )

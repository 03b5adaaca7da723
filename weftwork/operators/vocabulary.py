"""Vocabularies: word counts in first-seen order, caps, dictionary encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a vocabulary up to which it is broadcast; a larger one joins by shuffle.
BROADCAST_WORDS = 1_000_000


def tokens(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """key, pos and word of an array of words per row; places from 0."""
    return docs.select(F.col(key), F.posexplode(words).alias("pos", "word"))


def word_counts(rows: DataFrame, word: str, *order: str) -> DataFrame:
    """word, freq and first (the least of the whole numbers ``order``): one hash aggregation that combines before it shuffles.

    The numbers are packed into one decimal, the second (below 10 ** 10) behind the first; a struct's least would need a sort.
    """
    first = F.coalesce(F.col(order[0]).cast("decimal(20,0)"), F.lit(str(-(10**19))).cast("decimal(20,0)"))
    for more in order[1:]:
        first = first * F.lit(10**10).cast("decimal(11,0)") + F.col(more).cast("decimal(20,0)")
    return rows.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("freq"), F.min(first).alias("first"))


def vocabulary(counts: DataFrame, specials: list[str] = (), min_freq: int = 1, cap: int | None = None, order: str = "first") -> DataFrame:
    """word, freq, idx: specials first, then the words of at least ``min_freq`` in order, the first ``cap`` of them.

    ``order``: "first" (as seen) or "freq" (most frequent, then by word). A vocabulary is ranked as a whole, so one
    that can be large needs a cap, which bounds the rows that are ranked.
    """
    by = [F.col("first")] if order == "first" else [F.desc("freq"), F.col("word")]
    rows = counts.where(F.col("freq") >= min_freq)
    if cap is not None:
        rows = rows.orderBy(*by).limit(cap)  # a bounded top-k
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    ranked = ranked.select("word", "freq", (F.col("rank") - 1 + len(specials)).cast("long").alias("idx"))
    if not specials:
        return ranked
    first = counts.sparkSession.createDataFrame([(w, None, i) for i, w in enumerate(specials)], "word string, freq long, idx long")
    return first.union(ranked)


def _joined(rows: DataFrame, word: str, vocab: DataFrame) -> DataFrame:
    side = vocab.select(F.col("word").alias("_word"), F.col("idx").alias("_idx"))
    few = vocab.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return rows.join(F.broadcast(side) if few else side, F.col(word) == F.col("_word"), "left")


def encode(rows: DataFrame, word: str, vocab: DataFrame, unknown: int, to: str = "idx") -> DataFrame:
    """``rows`` with the word's index, ``unknown`` where the vocabulary lacks it."""
    return _joined(rows, word, vocab).withColumn(to, F.coalesce("_idx", F.lit(unknown))).drop("_word", "_idx")


def encode_strict(rows: DataFrame, word: str, vocab: DataFrame, to: str = "idx") -> DataFrame:
    """As ``encode``, but a word that the vocabulary lacks is an error."""
    missing = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce(F.col(word), F.lit("null"))))
    return _joined(rows, word, vocab).withColumn(to, F.when(F.col("_idx").isNull(), missing.cast("long")).otherwise(F.col("_idx"))).drop("_word", "_idx")


def sources(rows: DataFrame, **words: Column) -> DataFrame:
    """vocab and word of several vocabularies in one pass; each column is an array of words."""
    named = F.array(*[F.struct(F.lit(k).alias("vocab"), v.cast("array<string>").alias("words")) for k, v in words.items()])
    return rows.select("*", F.explode(named).alias("_v")).select(*rows.columns, "_v.vocab", F.posexplode("_v.words").alias("pos", "word"))

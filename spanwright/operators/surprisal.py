"""Layout of surprisal: sentence numbers, context windows, word scores from subword scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sentence_numbers(tokens: DataFrame, item: str = "item", order: str | list[str] = "zone", word: str = "word") -> DataFrame:
    """`tokens` with sentence_id (from 1; a word that ends in a period ends its sentence) and sentence_position (from 1)."""
    order = [order] if isinstance(order, str) else order
    before = Window.partitionBy(item).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = tokens.withColumn("sentence_id", (1 + F.coalesce(F.sum(F.when(F.endswith(word, F.lit(".")), 1).otherwise(0)).over(before), F.lit(0))).cast("int"))
    return own.withColumn("sentence_position", F.row_number().over(Window.partitionBy(item, "sentence_id").orderBy(*order)))


def context_windows(tokens: DataFrame, size: int = 128, stride: int = 1, item: str = "item", index: str = "i", pieces: str = "pieces") -> DataFrame:
    """First context word and number of context pieces of each word (tokens: item, i from 0, pieces).

    From the word before on, every `stride`-th word is taken until `size` pieces are held or
    `size` words were passed.
    """
    if size <= 1:
        none = F.lit(0).cast("long")
        return tokens.withColumns({"context_first": F.col(index).cast("long"), "context_pieces": none, "context_words": F.lit(0)})
    if stride == 1:
        return _consecutive_windows(tokens, size, item, index, pieces)
    return _strided_windows(tokens, size, stride, item, index, pieces)


def _strided_windows(tokens: DataFrame, size: int, stride: int, item: str, index: str, pieces: str) -> DataFrame:
    """The same with gaps, without a collected context: words of one residue of their place have sums of their own.

    For each word the window that ends with it follows from these running sums, as without gaps; the next
    word of the item takes that of the word before it.
    """
    place = F.col(index).cast("long")
    own = tokens.withColumns({"__r": F.pmod(place, F.lit(stride)), "__n": F.col(pieces).cast("long")})
    by_place = Window.partitionBy(item, "__r").orderBy(index)
    own = own.withColumn("__s", F.sum("__n").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("__e", F.col("__s") - F.col("__n"))
    passed = (size - 2) // stride  # words of the residue that may be passed besides the last one
    near = Window.partitionBy(item, "__r").orderBy("__s").rangeBetween(-(size - 1), 0)
    first = F.greatest(F.min(place).over(near), place - passed * stride, F.col("__r"))
    held = F.col("__s") - F.greatest(F.min("__e").over(near), F.coalesce(F.lag("__e", passed).over(by_place), F.lit(0).cast("long")))
    own = own.withColumn("__w", F.struct(first.alias("first"), held.alias("n"), ((place - first) / stride + 1).cast("int").alias("k")))
    before = F.lag("__w", 1).over(Window.partitionBy(item).orderBy(index))
    own = own.withColumn("__w", before).withColumns({
        "context_first": F.coalesce(F.col("__w.first"), place), "context_pieces": F.coalesce(F.col("__w.n"), F.lit(0).cast("long")), "context_words": F.coalesce(F.col("__w.k"), F.lit(0)),
    })
    return own.drop("__r", "__n", "__s", "__e", "__w")


def _consecutive_windows(tokens: DataFrame, size: int, item: str, index: str, pieces: str) -> DataFrame:
    """The same without gaps: the first word follows from running sums, so no context is collected.

    Words back to c are taken while the pieces behind c are fewer than `size`; sums only grow, so the
    first such c is one before the first word whose sum before it lies within `size` - 1 of that of the word itself.
    """
    by_place = Window.partitionBy(item).orderBy(index)
    whole = by_place.rowsBetween(Window.unboundedPreceding, -1)
    own = tokens.withColumn("__u", F.coalesce(F.sum(F.col(pieces).cast("long")).over(whole), F.lit(0).cast("long")))
    own = own.withColumns({"__back": F.coalesce(F.lag("__u", 1).over(by_place), F.lit(0).cast("long")), "__far": F.coalesce(F.lag("__u", size - 1).over(by_place), F.lit(0).cast("long"))})
    near = Window.partitionBy(item).orderBy("__u").rangeBetween(-(size - 1), 0)
    place = F.col(index).cast("long")
    first = F.least(place, F.greatest(F.min(place).over(near) - 1, place - (size - 1), F.lit(0)))
    own = own.withColumns({"context_first": first, "context_pieces": F.col("__u") - F.greatest(F.min("__back").over(near), F.col("__far"))})
    return own.withColumn("context_words", (place - F.col("context_first")).cast("int")).drop("__u", "__back", "__far")


def word_scores(scores: DataFrame, keys: list[str], order: str = "i", token: str = "token", score: str = "score", mark: str = "Ġ") -> DataFrame:
    """Surprisal of every word from the log scores of its subwords: a token with the mark begins a word."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    word = F.sum(F.when(F.startswith(token, F.lit(mark)), 1).otherwise(0)).over(upto)
    return scores.withColumn("word_index", word.cast("int")).groupBy(*keys, "word_index").agg((-F.sum(score)).alias("surprisal"), F.count("*").alias("n_pieces"))


def last_word_scores(scores: DataFrame, keys: list[str], order: str = "i", token: str = "token", score: str = "score", mark: str = "Ġ") -> DataFrame:
    """Surprisal of the last word of each stimulus."""
    words = word_scores(scores, keys, order, token, score, mark)
    return words.groupBy(*keys).agg(F.max_by("surprisal", "word_index").alias("surprisal"))

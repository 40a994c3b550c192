"""Entity grids, given and new entities, preceding context, segments of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present, slice_chars, strip


def first_sentences(mentions: DataFrame, doc: str = "doc") -> DataFrame:
    """First sentence of each cluster, mentions without a sentence left aside."""
    return mentions.groupBy(doc, "cluster").agg(F.min("sentence_index").alias("first_sentence"), F.count("*").alias("n_mentions"))


def with_givenness(mentions: DataFrame, doc: str = "doc") -> DataFrame:
    """`mentions` with givenness: given if the cluster has an earlier sentence, else new."""
    first = F.min("sentence_index").over(Window.partitionBy(doc, "cluster"))
    given = F.coalesce(first < F.col("sentence_index"), F.lit(False))
    return mentions.withColumn("givenness", F.when(given, F.lit("given")).otherwise(F.lit("new")))


def given_new(mentions: DataFrame, doc: str = "doc") -> DataFrame:
    """Per sentence: sorted distinct given and new clusters."""
    own = with_givenness(mentions, doc)
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("givenness") == kind, F.col("cluster"))))
    return own.groupBy(doc, "sentence_index").agg(of("given").alias("given_entities"), of("new").alias("new_entities"))


def entity_grid(mentions: DataFrame, doc: str = "doc", order: str = "pos") -> DataFrame:
    """Roles per (document, sentence, cluster), repeated and in mention order; clusters without any role have no row."""
    rows = mentions.where(present(F.col("role")))
    roles = F.transform(F.array_sort(F.collect_list(F.struct(order, "role"))), lambda x: x["role"])
    return rows.groupBy(doc, "sentence_index", "cluster").agg(roles.alias("roles"))


def grid_map(grid: DataFrame, doc: str = "doc") -> DataFrame:
    """The grid of a sentence as a map from cluster id (a string) to roles."""
    entry = F.struct(F.col("cluster"), F.col("roles"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["cluster"].cast("string"), e["roles"]))
    return grid.groupBy(doc, "sentence_index").agg(F.map_from_entries(entries).alias("entity_grid"))


def context_start(window: int | None, start: str = "char_start", doc: str = "doc", index: str = "sentence_index") -> Column:
    """Where the context of a sentence begins: `window` sentences before, or the start of the text."""
    if window is None:
        return F.lit(0)
    order = Window.partitionBy(doc).orderBy(index)
    behind = F.coalesce(F.lag(start, window).over(order), F.first(start).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(F.coalesce(behind, F.lit(0)))


def with_context(sentences: DataFrame, window: int | None = None, doc: str = "doc") -> DataFrame:
    """Sentences (doc, sentence_index, text, char_start, char_end) with the text before them, stripped."""
    begun = sentences.withColumn("__from", context_start(window, doc=doc))
    return begun.withColumn("context", strip(slice_chars(F.col("text"), F.col("__from"), F.col("char_start")))).drop("__from")


def rows_context(rows: DataFrame, doc: str, order: str, text: str, window: int | None = None, sep: str = " ") -> DataFrame:
    """Rows with the texts of the rows before them (at most `window`), joined."""
    frame = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding if window is None else -window, -1)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(frame), sep))


def join_segments(parts: list[tuple[str, Column]], sep: str = " ") -> tuple[Column, Column]:
    """The text that joins non-empty segments, and their places (name, char_start, char_end).

    An empty segment is a zero-width place where it would stand; white space at the very end is
    trimmed from the text, not from the places.
    """
    at, places, text = F.lit(0), [], []
    for name, part in parts:
        part = F.coalesce(part, F.lit(""))
        places.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("char_start"), (at + F.length(part)).cast("int").alias("char_end")))
        at = at + F.when(part != "", F.length(part) + len(sep)).otherwise(F.lit(0))
        text.append(F.when(part != "", F.concat(part, F.lit(sep))).otherwise(F.lit("")))
    return F.regexp_replace(F.concat(*text), r"(?U)\s+$", ""), F.array(*places)


def target_mentions(mentions: DataFrame, sentences: DataFrame, doc: str = "doc") -> DataFrame:
    """Mentions in the coordinates of their sentence, cut to it, with the text of the cut span.

    `sentences` have the text of the document, or, with text_start, that from this place of it on: with their
    own text only, no whole text is repeated for each sentence.
    """
    from .spans import clamp

    own = mentions.join(sentences.select(doc, "sentence_index", "text", F.col("char_start").alias("cs"), F.col("char_end").alias("ce"), _text_start(sentences)).hint("merge"), [doc, "sentence_index"])
    start, end = clamp(F.col("char_start"), F.col("char_end"), F.col("cs"), F.col("ce"))
    sentence = slice_chars(F.col("text"), F.col("cs") - F.col("ts"), F.col("ce") - F.col("ts"))
    own = own.withColumns({"char_start": start, "char_end": end}).withColumn("mention_text", slice_chars(sentence, F.col("char_start"), F.col("char_end")))
    return own.drop("text", "cs", "ce", "ts")


def _text_start(sentences: DataFrame) -> Column:
    return (F.col("text_start") if "text_start" in sentences.columns else F.lit(0)).alias("ts")


def target_tokens(tokens: DataFrame, sentences: DataFrame, doc: str = "doc") -> DataFrame:
    """Parse tokens in the coordinates of their sentence: i, head (places among its tokens; -1 without), char_start, char_end.

    `tokens` have g, head_g, char_start, char_end and sentence_index; `sentences` char_start and token_gids. Sentences
    without a place have none.
    """
    own = sentences.where(F.col("char_start").isNotNull()).select(doc, "sentence_index", F.col("char_start").alias("cs"), "token_gids")
    own = tokens.join(own.hint("merge"), [doc, "sentence_index"])
    place = lambda g: (F.coalesce(F.array_position("token_gids", F.col(g)), F.lit(0)) - 1).cast("int")
    local = {"i": place("g"), "head": place("head_g"), "char_start": F.col("char_start") - F.col("cs"), "char_end": F.col("char_end") - F.col("cs")}
    return own.withColumns(local).drop("cs", "token_gids")


def target_entities(entities: DataFrame, sentences: DataFrame, tokens: DataFrame, doc: str = "doc") -> DataFrame:
    """Entities (char_start, char_end and others) that lie in one sentence, in its coordinates, with their text and gold role.

    `sentences` have text (of the document, or from text_start on), char_start and char_end; entities that straddle them are left out.
    """
    from .spans import head_role, overlap_join

    names = [c for c in entities.columns if c != doc]
    whole = sentences.select(doc, "sentence_index", F.col("char_start").alias("cs"), F.col("char_end").alias("ce"))
    texts = sentences.select(doc, "sentence_index", "text", _text_start(sentences))
    ours = entities.withColumns({"es": F.col("char_start"), "ee": F.col("char_end")})
    inside = overlap_join(ours, whole, [doc], ("es", "ee"), ("cs", "ce")).where((F.col("es") >= F.col("cs")) & (F.col("ee") <= F.col("ce")))
    toks = tokens.select(doc, "g", "dep", "head_g", F.col("char_start").alias("ts"), F.col("char_end").alias("te"))
    spans = entities.select(doc, F.col("char_start").alias("es"), F.col("char_end").alias("ee")).distinct()
    roles = head_role(overlap_join(spans, toks, [doc], ("es", "ee"), ("ts", "te")), [doc, "es", "ee"]).select(doc, "es", "ee", "grammatical_role")
    # Texts come last, as the overlap join copies sentences into every bucket that they touch.
    out = inside.join(roles.hint("merge"), [doc, "es", "ee"], "left").join(texts.hint("merge"), [doc, "sentence_index"])
    out = out.withColumn("entity_text", slice_chars(F.col("text"), F.col("es") - F.col("ts"), F.col("ee") - F.col("ts")))
    out = out.withColumns({"char_start": F.col("es") - F.col("cs"), "char_end": F.col("ee") - F.col("cs")})
    return out.select(doc, "sentence_index", *names, "entity_text", "grammatical_role")

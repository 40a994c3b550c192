"""Character offsets of tokens, and alignment of parse forms to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TREEBANK_FORMS, candidates, find
from .rt import last_of


def token_offsets(tokens: DataFrame, item: str = "item", zone: str = "zone", word: str = "word") -> DataFrame:
    """char_start and char_end of each word in the text that joins an item's words by one space; repeated
    zones stand in the order of `pos`, where there is such a column."""
    before = Window.partitionBy(item).orderBy(zone, *["pos"] * ("pos" in tokens.columns)).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(word) + 1).over(before), F.lit(0)).cast("int")
    return tokens.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(word))


def story_text(tokens: DataFrame, item: str = "item", zone: str = "zone", word: str = "word") -> DataFrame:
    """One row per item: its text, and its tokens in order as structs."""
    places = [c for c in ("char_start", "pos") if c in tokens.columns]
    rest = [c for c in tokens.columns if c not in (item, zone, "pos")]
    rows = F.sort_array(F.collect_list(F.struct(F.struct(zone, *places).alias("at"), F.struct(F.col(zone), *rest).alias("token"))))
    ordered = F.transform(rows, lambda r: r["token"])
    stories = tokens.groupBy(item).agg(ordered.alias("tokens"))
    return stories.withColumn("text", F.array_join(F.transform("tokens", lambda t: t[word]), " ")).withColumn("n_tokens", F.size("tokens"))


def place_forms(text: Column, zone_start: Column, zone_end: Column, forms: Column) -> Column:
    """Spans of a zone's parse forms, found from left to right.

    Each form is looked for behind the one before, its candidates in turn, up to the end of the
    zone; one that isn't found takes as many characters as it is long from there on.
    """
    span = "struct<char_start: int, char_end: int>"

    def step(state: Column, form: Column) -> Column:
        at, end = state["at"], zone_end

        def spot(c: Column) -> Column:
            return F.transform(F.array(find(text, c, at, end)), lambda start: F.struct(start.cast("int").alias("char_start"), (start + F.length(c)).cast("int").alias("char_end")))[0]

        found = F.filter(F.transform(candidates(form), spot), lambda s: s["char_start"] >= 0)
        fallback = F.struct(at.cast("int").alias("char_start"), (at + F.least(F.length(form), F.greatest(end - at, F.lit(0)))).cast("int").alias("char_end"))
        # By a list of one, so that the place is found once, and not for each use of it.
        own = F.array(F.coalesce(F.get(found, F.lit(0)), fallback))
        return F.transform(own, lambda s: F.struct(s["char_end"].alias("at"), F.concat(state["out"], F.array(s)).alias("out")))[0]

    begin = F.struct(zone_start.cast("int").alias("at"), F.array().cast(f"array<{span}>").alias("out"))
    return F.aggregate(forms, begin, step, lambda s: s["out"])


def numbered(parse: DataFrame, item: str, order: list[str]) -> DataFrame:
    """`parse` with g, the place of a token in its story, and head_g, that of its head (-1: a root)."""
    own = parse.withColumn("g", (F.row_number().over(Window.partitionBy(item).orderBy("sentence_index", *order)) - 1).cast("int"))
    first = F.min("g").over(Window.partitionBy(item, "sentence_index"))
    return own.withColumn("head_g", F.when(F.col("head") > 0, first + F.col("head") - 1).otherwise(F.lit(-1)).cast("int"))


def align_parse(stories: DataFrame, parse: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Parse tokens (item, sentence_index, pos, id, form, tag, head, dep, zone) with spans and story-wide numbers.

    Tokens of a sentence are grouped by zone, in the order in which zones first occur; g counts
    them through the story, and head_g is the sentence's first g plus the head's number, -1 for
    a root. Tokens without a zone have no span. `words` (item, zone, word, char_start) are those of the stories, where they
    are at hand and need not be taken from them.
    """
    words = stories.select("item", F.explode("tokens").alias("t")).select("item", "t.*") if words is None else words
    zones = words.select("item", "zone", "word", F.col("char_start").alias("zs"))
    zones = last_of(zones, ["item", "zone"], "zs")
    own = numbered(parse.withColumn("zone_first", F.min("pos").over(Window.partitionBy("item", "sentence_index", "zone"))), "item", ["zone_first", "pos"])
    grouped = own.groupBy("item", "sentence_index", "zone").agg(F.sort_array(F.collect_list(F.struct("pos", "g", "form", "tag", "dep", "head_g"))).alias("ts"))
    placed = grouped.join(zones.hint("merge"), ["item", "zone"], "left")
    # The text of a zone is its word, so forms are looked for in that and not in the whole story.
    spans = place_forms(F.col("word"), F.lit(0), F.length("word"), F.transform("ts", lambda t: t["form"]))
    # A form that is the word, as most are, is all of it; only others are looked for.
    form, n = F.get("ts", F.lit(0))["form"], F.length("word")
    plain = (F.size("ts") == 1) & (form == F.col("word")) & (n > 0) & ~form.isin(*[f for forms, _ in TREEBANK_FORMS for f in forms])
    spans = F.when(plain, F.array(F.struct(F.lit(0).alias("char_start"), n.alias("char_end")))).otherwise(spans)
    placed = placed.withColumn("spans", F.when(F.col("zs").isNotNull(), spans))
    both = placed.select("item", "sentence_index", "zone", "zs", "spans", F.posexplode("ts").alias("i", "t"))
    span = F.get("spans", F.col("i"))
    return both.select("item", "sentence_index", "zone", "t.g", "t.form", "t.tag", "t.dep", "t.head_g", (F.col("zs") + span["char_start"]).alias("char_start"), (F.col("zs") + span["char_end"]).alias("char_end"))


def sentence_spans(aligned: DataFrame, *more: Column) -> DataFrame:
    """Per sentence: span from the first to the last placed token (null without any), zones in order of first use, gs, and what `more` aggregates."""
    zones = F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("g", "zone"))), lambda x: x["zone"]))
    return aligned.groupBy("item", "sentence_index").agg(
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.array_distinct(zones).alias("zones"), F.sort_array(F.collect_list("g")).alias("token_gids"), *more
    )

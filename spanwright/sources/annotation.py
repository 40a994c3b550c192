"""Manual annotation tables: reading, mention runs, antecedents, validation, and the templates to fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a finished annotation, and of a template (fixed values).
ANNOTATED = ("story_id", "sent_id", "token_id", "deprel", "form", "cluster", "mention", "comment")
TEMPLATE = ("story_id", "sent_id", "token_id", "deprel", "form", "GRP", "etype", "infstat", "minspan", "link", "identity")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """A `;`-separated annotation with pos, the place of a row; token ids stay strings (1.10 is not 1.1)."""
    schema = ", ".join(f"{c} string" for c in ANNOTATED)
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    parsed = F.from_csv("line", F.lit(schema), {"sep": ";", "escape": '"', "mode": "PERMISSIVE"})
    rows = raw.where((F.col("pos") > 0) & (F.length("line") > 0)).select("pos", parsed.alias("r")).select("pos", "r.*")
    return rows.withColumns({"story_id": F.col("story_id").try_cast("int"), "sent_id": F.col("sent_id").try_cast("int")})


def antecedents(value: Column) -> Column:
    """Cluster ids of a cell: one, or several of a split antecedent, joined by + or -."""
    return F.filter(F.transform(F.split(value, r"[+-]"), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def mention_runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of consecutive rows with one value: keys, value, first, last, n."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    own = rows.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).withColumn("__i", island)
    return own.groupBy(*keys, value, "__i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__i")


def annotated_mentions(rows: DataFrame) -> DataFrame:
    """Mentions of a finished annotation: story_id, sent_id, cluster, introducing, first, last, n."""
    parts = []
    for column, introducing in (("cluster", True), ("mention", False)):
        runs = mention_runs(rows, ["story_id", "sent_id"], "pos", column)
        parts.append(runs.select("story_id", "sent_id", F.explode(antecedents(F.col(column))).alias("cluster"), F.lit(introducing).alias("introducing"), "first", "last", "n"))
    return parts[0].unionByName(parts[1])


def problems(mentions: DataFrame) -> DataFrame:
    """Clusters that are introduced twice, never, or after a mention: story_id, cluster, problem."""
    introduced = F.when(F.col("introducing"), F.col("first"))
    seen = mentions.groupBy("story_id", "cluster").agg(F.count(introduced).alias("n"), F.min(introduced).alias("at"), F.min(F.when(~F.col("introducing"), F.col("first"))).alias("used"))
    found = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, "introduced more than once"), F.when(F.col("n") == 0, "never introduced"), F.when(F.col("used") < F.col("at"), "mentioned before its introduction")
        )
    )
    return seen.select("story_id", "cluster", F.explode(found).alias("problem"))


def annotation_template(parse: DataFrame) -> DataFrame:
    """Rows to annotate from a parse (item, sentence_index, pos, zone, form, dep): the template's columns, the last six empty.

    Sentences count from 0 within a story; a zone's second token and further ones are zone.2 and so on.
    """
    sub = F.row_number().over(Window.partitionBy("item", "zone").orderBy("sentence_index", "pos"))
    of_zone = F.count("*").over(Window.partitionBy("item", "zone"))
    base = F.min("sentence_index").over(Window.partitionBy("item"))
    own = parse.withColumns({"__sub": sub, "__n": of_zone, "__base": base})
    token = F.when(F.col("__n") == 1, F.col("zone").cast("string")).otherwise(F.concat_ws(".", F.col("zone").cast("string"), F.col("__sub").cast("string")))
    out = own.select("item", "sentence_index", "pos", F.col("item").alias("story_id"), (F.col("sentence_index") - F.col("__base")).alias("sent_id"), token.alias("token_id"), F.col("dep").alias("deprel"), "form")
    return out.select(*out.columns, *[F.lit("").alias(c) for c in TEMPLATE[5:]])


def write_templates(template: DataFrame, path: str) -> None:
    """One folder per story with one `;`-separated file, header included, rows in order."""
    rows = template.repartition("story_id").sortWithinPartitions("story_id", "sentence_index", "pos")
    rows = rows.select(F.col("story_id").alias("story"), *TEMPLATE)
    rows.write.partitionBy("story").option("sep", ";").option("header", True).option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)

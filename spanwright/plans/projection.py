"""The driver's tables seen as stories, sentences, mentions, tokens and reading times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.distance import role_class

ALTERNATIVES = 3
#: Sentences whose comparisons one deal of rows holds.
BLOCK = 32
#: Bytes of the documents table, as it is stored, whose tokens one task holds.
DEAL = 2 << 20
BLANK = "[ \\t\\n\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """item, zone (from 1), word of every document.

    If `dealt`, documents are dealt by item while they are whole texts, so that what follows item by item moves no tokens.
    """
    stored = table(spark, sf_dir, "documents")
    docs = stored.select(F.col("doc_id").alias("item"), "text")
    if dealt:
        _join_in_place(spark)
        docs = docs.repartition(_deals(stored), "item")
    return docs.select("item", F.posexplode(F.split("text", BLANK)).alias("zone", "word")).withColumn("zone", F.col("zone") + 1)


def _join_in_place(spark: SparkSession) -> None:
    """From now on in this session, sides that were dealt by a document are joined by it and more (a bucket, a sentence)
    where they are. Spark deals both sides again by all columns of such a join, unless told otherwise."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _deals(docs: DataFrame) -> int:
    """Tasks that documents are dealt to: more with the table, so that none sorts more tokens than fit into its memory.

    `docs` with all columns: Spark takes a share of the table's bytes for some of them, whatever they hold.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(_tasks(docs.sparkSession), -(-size // DEAL))


def events_rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, worker, item, zone, rt."""
    e = table(spark, sf_dir, "events")
    zone = (1 + F.pmod(F.floor(F.col("event_id") / 50), F.lit(200))).cast("int")
    return e.select("event_id", F.col("user_id").alias("worker"), F.pmod("event_id", F.lit(50)).alias("item"), zone.alias("zone"), F.col("value").alias("rt"))


def rt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, zone, mean_rt, gmean_rt, n_subj."""
    rts = events_rt(spark, sf_dir)
    return rts.groupBy("item", "zone").agg(F.avg("rt").alias("mean_rt"), F.exp(F.avg(F.log(F.when(F.col("rt") > 0, F.col("rt"))))).alias("gmean_rt"), F.count("*").alias("n_subj"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, sentence_index, order_key: the orders of a customer, by date."""
    o = table(spark, sf_dir, "orders")
    index = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("doc"), index.alias("sentence_index"), F.col("o_orderkey").alias("order_key"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, sentence_index, pos, cluster, dep, role, form, etype, text: the lines of an order."""
    lines = table(spark, sf_dir, "lineitem")
    own = sentences(spark, sf_dir).join(lines, F.col("order_key") == F.col("l_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    dep = F.when(F.col("l_returnflag") == "A", "nsubj").when(F.col("l_returnflag") == "N", "dobj").otherwise("nmod")
    return own.select(
        "doc",
        "sentence_index",
        (F.row_number().over(order) - 1).alias("pos"),
        F.pmod("l_partkey", F.lit(20)).alias("cluster"),
        dep.alias("dep"),
        role_class(dep).alias("role"),
        F.when(F.col("l_linestatus") == "O", "pronoun").otherwise("definite_np").alias("form"),
        F.when(F.pmod("l_partkey", F.lit(3)) == 0, "person").otherwise("other").alias("etype"),
        F.concat_ws(" ", F.lit("the"), F.col("l_returnflag"), F.concat(F.lit("p"), F.pmod("l_partkey", F.lit(7)).cast("string"))).alias("text"),
    )


def _shifted(df: DataFrame) -> DataFrame:
    ks = df.withColumn("k", F.explode(F.array(*map(F.lit, range(ALTERNATIVES + 1))))).withColumn("i", F.col("sentence_index") - F.col("k"))
    return ks.where("i >= 0")


def _block(sentence: Column) -> Column:
    return F.floor(sentence / BLOCK)


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, i, k, block: sentence i (k = 0) and the sentences that stand in for its alternatives."""
    return _shifted(sentences(spark, sf_dir)).select("doc", "i", "k", _block(F.col("i")).alias("block"))


def targets(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Mentions of every side; an entity is given if it occurs before sentence i.

    `dealt` by blocks of sentences i, of which they have the number in `block`: a mention goes once to each
    block that compares it and is repeated for its sides there, so comparisons by doc, i and block move no row again.
    """
    first = F.min("sentence_index").over(Window.partitionBy("doc", "cluster"))
    own = mentions(spark, sf_dir).withColumn("first", first)
    if dealt:
        _join_in_place(spark)
        s = F.col("sentence_index")
        blocks = F.sequence(_block(F.greatest(s - ALTERNATIVES, F.lit(0))), _block(s))
        own = own.withColumn("block", F.explode(blocks)).repartition(_tasks(spark), "doc", "block")
    own = _shifted(own)
    own = own.where(F.col("block") == _block(F.col("i"))) if dealt else own
    return own.withColumn("givenness", F.when(F.col("first") < F.col("i"), "given").otherwise("new")).drop("first")


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, i, cluster, role: mentions of the sentence before sentence i."""
    own = mentions(spark, sf_dir)
    return own.select("doc", (F.col("sentence_index") + 1).alias("i"), "cluster", "role")


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, past, cluster, role: mentions of all sentences, once each."""
    return mentions(spark, sf_dir).select("doc", F.col("sentence_index").alias("past"), "cluster", "role")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, span, window, cluster, char_start, char_end: runs of one to three tokens, one from each word."""
    own = offsets(spark, sf_dir)
    length = 1 + F.pmod(F.col("zone"), F.lit(3))
    end = Window.partitionBy("item").orderBy("zone")
    last = F.when(length == 1, F.col("char_end")).when(length == 2, F.lead("char_end", 1).over(end)).otherwise(F.lead("char_end", 2).over(end))
    rows = own.withColumn("last", F.coalesce(last, F.col("char_end")))
    return rows.select(F.col("item").alias("doc"), F.col("zone").cast("long").alias("span"), F.pmod("zone", F.lit(2)).alias("window"), F.pmod("zone", F.lit(8)).alias("cluster"), "char_start", F.col("last").alias("char_end"))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.align import token_offsets

    return token_offsets(tokens(spark, sf_dir))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, sentence_index, pos (from 0), head (from 1, 0: root), dep: the binary tree over the lines of an order."""
    own = mentions(spark, sf_dir)
    return own.withColumn("head", F.floor((F.col("pos") + 1) / 2).cast("int"))

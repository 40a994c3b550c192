"""Quality rules judged per document and per host, in Spark expressions only.

A document first meets the base rules. Their failures are counted per host (a grouped
aggregation with map-side partial sums), each host's failure rate is shrunk toward the
corpus by a beta prior that is itself estimated from the hosts (method of moments), and the
verdict on the host is joined back: a host whose shrunk rate is certainly above
`max_host_rate` takes all its documents with it.

Defined cases: a null text has no words (all counts 0, base_failed true); a null host is the
host "". Repeated rows each count and each come back. An empty table gives an empty result.
Columns of the input that the rules do not use pass through; columns named like a result
are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, let, materialize, shielded

#: Rule parameters of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected if its shrunk failure rate less `z` posterior deviations exceeds this.
MAX_HOST_RATE, Z = 0.5, 2.0
#: Bounds of the prior's strength in pseudo-documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 10_000.0

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Windows are keyed by 64-bit hashes and sorted, so the cost is n log n for any text;
    equal keys are then neighbours, and the covered words are summed over the positions.
    """

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(windows: Column) -> Column:
        same = lambda x, i: (x["k"] == F.get(windows, i - 1)["k"]) | (x["k"] == F.get(windows, i + 1)["k"])
        return F.sort_array(F.transform(F.filter(windows, same), lambda x: x["i"]))

    def windows(h: Column) -> Column:
        keyed = F.transform(h, lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("i")))
        return F.sort_array(F.slice(keyed, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda s: let(positions(s), covered)))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and `base_failed` to every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    kept = [c for c in docs.columns if c.lower() not in {*RESULT, "__rules"}]
    rules = docs.select(
        *kept,
        of_words.alias("__rules"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
    )
    rules = rules.select(*kept, "__rules.n_words", "__rules.word_chars", "n_symbols", "n_dup_lines", "__rules.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rules.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host: str, max_host_rate: float = MAX_HOST_RATE, z: float = Z) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_kept for every host of `judged`."""
    sites = judged.groupBy(F.col(host)).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = sites.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
        F.avg(1 / F.col("n_docs")).alias("inv_n"),
    )
    m = F.col("m")
    # Rates scatter by sampling as well; what is left of the variance belongs to the hosts.
    between = F.greatest(F.col("v") - m * (1 - m) * F.col("inv_n"), F.lit(1e-9))
    prior = prior.select(m, F.least(F.greatest(m * (1 - m) / between - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)).alias("k"))
    mean = (F.col("n_failed") + F.col("k") * m) / (F.col("n_docs") + F.col("k"))
    deviation = F.sqrt(F.greatest(F.col("host_rate") * (1 - F.col("host_rate")), F.lit(0.0)) / (F.col("n_docs") + F.col("k") + 1))
    sites = sites.join(F.broadcast(prior)).withColumn("host_rate", mean)
    return sites.select(host, "n_docs", "n_failed", "host_rate", (F.col("host_rate") - z * deviation <= max_host_rate).alias("host_kept"))


def host_rules(docs: DataFrame, host: str = "source", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every document with its base counts, `base_failed`, `host_rate` and `kept`."""
    key = "__host"
    judged = base_rules(docs.withColumn(key, F.coalesce(F.col(host), F.lit(""))), text)
    judged = judged.drop("host_rate", "kept")
    judged = materialize(judged if keep_text else judged.drop(text), "host_rules")
    verdicts = materialize(host_verdicts(judged, key), "host_verdicts")
    out = attach(judged, verdicts.select(key, "host_rate", "host_kept"), [key])
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop(key, "host_kept")


def drop_failed(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns of `docs`."""
    return shielded(docs, {*RESULT, "host_rate", "host_kept", "kept"}, lambda own: host_rules(own, host, text).where("kept"))


def op5_host_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return host_rules(docs, keep_text=False).select("doc_id", *RESULT, "kept", F.round("host_rate", 9).alias("host_rate"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols
  FROM w),
l AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, i
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws)::BIGINT - 1)) AS i FROM w)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p) GROUP BY doc_id),
j AS (
  SELECT doc_id, host, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM b LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
s AS (SELECT host, count(*)::DOUBLE AS n_docs, sum(base_failed::INT)::DOUBLE AS n_failed FROM j GROUP BY host),
q AS (SELECT sum(n_failed) / sum(n_docs) AS m, coalesce(var_pop(n_failed / n_docs), 0) AS v, avg(1 / n_docs) AS inv_n FROM s),
k AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv_n, 1e-9) - 1, 2.0), 10000.0) AS k FROM q),
h AS (SELECT host, n_docs, (n_failed + k * m) / (n_docs + k) AS host_rate, n_docs + k + 1 AS weight FROM s, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate - 2.0 * sqrt(greatest(host_rate * (1 - host_rate), 0) / weight) <= 0.5 AS kept,
       round(host_rate, 9) AS host_rate
FROM j JOIN h USING (host)
"""

"""Registered queries over the driver's tables, with the SQL that each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, audit, discourse, distance, mixed, rt, spans, stats, surprisal, windows
from ..sources import readers, sinks
from ..sources.conllx import load_conllx
from ..sources.shared import shared_folder
from . import projection as P

QUERIES: dict = {}
ORACLE_SQL: dict = {}
KEYS = ["doc", "i"]
#: The same with the block of i, by which mentions are dealt.
DEALT = [*KEYS, "block"]


def _sql(name: str, sql: str | None, *parts: str):
    """Register the decorated query, and its SQL after the named common tables."""
    if sql:
        tables = [TABLES[p] for p in _needed(parts)]
        ORACLE_SQL[name] = ("WITH " + ", ".join(tables) + " " if tables else "") + sql

    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def _needed(parts: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for p in parts:
        for q in (*_needed(DEPENDS.get(p, ())), p):
            if q not in out:
                out.append(q)
    return out


DEPENDS = {
    "off": ("tok",), "sn": ("tok",), "stats": ("rt",), "spans": ("off",), "men": ("sent",), "sides": ("sent",), "targ": ("men",),
    "ctx": ("men", "sent"), "prev": ("men",), "feat": ("targ",), "pairs": ("feat", "sides"), "zones": ("sn",), "grid": ("men",),
}
TABLES = {
    "tok": r"tok AS (SELECT doc_id AS item, unnest(ws) AS word, unnest(range(1, len(ws)::BIGINT + 1))::INT AS zone FROM (SELECT doc_id, string_split_regex(text, '[ \t\n\r]+') AS ws FROM documents))",
    "off": "off AS (SELECT *, char_start + length(word) AS char_end FROM (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY item ORDER BY zone ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_start FROM tok))",
    "rt": "rt AS (SELECT event_id, user_id AS worker, event_id % 50 AS item, (1 + (event_id // 50) % 200)::INT AS zone, value AS rt FROM events)",
    "stats": "stats AS (SELECT item, zone, avg(rt) AS mean_rt, exp(avg(CASE WHEN rt > 0 THEN ln(rt) END)) AS gmean_rt, count(*) AS n_subj FROM rt GROUP BY item, zone)",
    "sn": "sn AS (SELECT *, (1 + coalesce(sum(CASE WHEN ends_with(word, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY zone ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS sentence_id FROM tok)",
    "zones": "zones AS (SELECT item, zone, word, sentence_id - 1 AS sentence_index FROM sn)",
    "sent": "sent AS (SELECT o_custkey AS doc, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS sentence_index FROM orders)",
    "men": """men AS (SELECT doc, sentence_index, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, l_shipdate) - 1)::INT AS pos,
      l_partkey % 20 AS cluster, CASE l_returnflag WHEN 'A' THEN 'nsubj' WHEN 'N' THEN 'dobj' ELSE 'nmod' END AS dep, CASE l_returnflag WHEN 'A' THEN 'subject' WHEN 'N' THEN 'object' ELSE 'oblique' END AS role,
      CASE WHEN l_linestatus = 'O' THEN 'pronoun' ELSE 'definite_np' END AS form, CASE WHEN l_partkey % 3 = 0 THEN 'person' ELSE 'other' END AS etype,
      'the ' || l_returnflag || ' p' || (l_partkey % 7) AS text FROM sent JOIN lineitem ON l_orderkey = o_orderkey)""",
    "sides": "sides AS (SELECT doc, sentence_index - k AS i, k FROM sent, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE sentence_index >= k)",
    "targ": """targ AS (SELECT doc, sentence_index - k AS i, k, cluster, role, form, etype, text, CASE WHEN first < sentence_index - k THEN 'given' ELSE 'new' END AS givenness
      FROM (SELECT *, min(sentence_index) OVER (PARTITION BY doc, cluster) AS first FROM men), (SELECT unnest([0, 1, 2, 3]) AS k) WHERE sentence_index >= k)""",
    "prev": "prev AS (SELECT doc, sentence_index + 1 AS i, cluster, role FROM men)",
    "ctx": "ctx AS (SELECT s.doc, s.sentence_index AS i, m.sentence_index AS past, cluster, role FROM sent s JOIN men m ON s.doc = m.doc AND m.sentence_index < s.sentence_index)",
    "feat": "feat AS (SELECT doc, i, k, CASE WHEN givenness = 'new' THEN 'NEW-' || etype ELSE cluster::VARCHAR END || '|' || givenness || '|' || form || '|' || role AS feature, CASE role WHEN 'subject' THEN 3.0 WHEN 'object' THEN 2.0 WHEN 'oblique' THEN 1.0 ELSE 0.5 END AS w FROM targ)",
    "pairs": """v AS (SELECT doc, i, k, feature, count(*)::DOUBLE AS n, sum(w)::DOUBLE AS sw FROM feat GROUP BY ALL),
      t AS (SELECT doc, i, k, sum(n) AS n, sum(sw) AS sw FROM v GROUP BY ALL),
      p AS (SELECT doc, i, k, feature, v.n / t.n AS share, v.sw / t.sw AS wshare FROM v JOIN t USING (doc, i, k)),
      ga AS (SELECT doc, i, k, feature, sum(g) AS g, sum(a) AS a, sum(wg) AS wg, sum(wa) AS wa FROM (
        SELECT s.doc, s.i, s.k, feature, share AS g, 0 AS a, wshare AS wg, 0 AS wa FROM sides s JOIN p ON p.doc = s.doc AND p.i = s.i AND p.k = 0 WHERE s.k > 0
        UNION ALL SELECT doc, i, k, feature, 0, share, 0, wshare FROM p WHERE k > 0) GROUP BY ALL)""",
    "spans": """spans AS (SELECT item AS doc, zone::BIGINT AS span, zone % 2 AS w, zone % 8 AS cluster, char_start AS cs, coalesce(CASE zone % 3 WHEN 0 THEN char_end WHEN 1 THEN n1 ELSE n2 END, char_end) AS ce
      FROM (SELECT *, lead(char_end, 1) OVER (PARTITION BY item ORDER BY zone) AS n1, lead(char_end, 2) OVER (PARTITION BY item ORDER BY zone) AS n2 FROM off))""",
    "grid": "grid AS (SELECT doc, sentence_index, cluster, string_agg(dep, ',' ORDER BY pos) AS roles FROM men GROUP BY ALL)",
}


# ---- reading times

def _zones(spark, sf):
    return surprisal.sentence_numbers(P.tokens(spark, sf)).withColumn("sentence_index", F.col("sentence_id") - 1)


@_sql("rt_left_join", "SELECT item, zone, word, round(mean_rt, 6) AS mean_rt, round(gmean_rt, 6) AS gmean_rt, coalesce(n_subj, 0) AS n_subj FROM tok LEFT JOIN stats USING (item, zone)", "tok", "stats")
def rt_left_join(spark, sf):
    out = rt.join_reading_times(P.tokens(spark, sf, dealt=False), P.rt_stats(spark, sf))
    return out.select("item", "zone", "word", F.round("mean_rt", 6).alias("mean_rt"), F.round("gmean_rt", 6).alias("gmean_rt"), F.coalesce("n_subj", F.lit(0)).alias("n_subj"))


@_sql(
    "rt_sentence_rollup",
    """SELECT item, sentence_index, count(*) AS n_spr_tokens, round(sum(mean_rt), 6) AS reading_time_sum_mean, round(sum(gmean_rt), 6) AS reading_time_sum_gmean,
       round(avg(mean_rt), 6) AS reading_time_mean_per_token, min(zone) AS first_zone, max(zone) AS last_zone FROM zones LEFT JOIN stats USING (item, zone) GROUP BY item, sentence_index""",
    "zones", "stats",
)
def rt_sentence_rollup(spark, sf):
    out = rt.sentence_rollup(rt.join_reading_times(_zones(spark, sf), P.rt_stats(spark, sf)))
    rounded = [F.round(c, 6).alias(c) for c in ("reading_time_sum_mean", "reading_time_sum_gmean", "reading_time_mean_per_token")]
    return out.select("item", "sentence_index", "n_spr_tokens", *rounded, F.array_min("spr_zones").alias("first_zone"), F.array_max("spr_zones").alias("last_zone"))


@_sql("rt_subject_rollup", "SELECT item, sentence_index, worker, round(sum(rt), 3) AS rt_sum, count(*) AS n_tokens FROM zones JOIN rt USING (item, zone) GROUP BY ALL", "zones", "rt")
def rt_subject_rollup(spark, sf):
    return rt.subject_rollup(_zones(spark, sf), P.events_rt(spark, sf))


@_sql("rt_subject_map", "SELECT item, sentence_index, count(*) AS n_workers, round(sum(rt_sum), 3) AS total FROM (SELECT item, sentence_index, worker, round(sum(rt), 3) AS rt_sum FROM zones JOIN rt USING (item, zone) GROUP BY ALL) GROUP BY ALL", "zones", "rt")
def rt_subject_map(spark, sf):
    m = F.map_values("reading_times_by_subject")
    out = rt.subject_map(rt_subject_rollup(spark, sf))
    return out.select("item", "sentence_index", F.size(m).cast("long").alias("n_workers"), F.round(F.aggregate(m, F.lit(0.0), lambda a, x: a + x["rt_sum"]), 3).alias("total"))


@_sql("rt_dedup_last", "SELECT item, worker, arg_max(rt, event_id) AS rt, arg_max(zone, event_id) AS zone FROM rt GROUP BY item, worker", "rt")
def rt_dedup_last(spark, sf):
    return rt.last_of(P.events_rt(spark, sf), ["item", "worker"], "event_id").select("item", "worker", "rt", "zone")


@_sql("rt_shared_zone", "SELECT zone, max(sentence_index) AS sentence_index, item FROM (SELECT item, zone % 100 AS zone, sentence_index FROM zones) GROUP BY item, zone", "zones")
def rt_shared_zone(spark, sf):
    sents = _zones(spark, sf).groupBy("item", "sentence_index").agg(F.collect_set(F.pmod("zone", F.lit(100))).alias("zones"))
    return rt.sentence_of_zone(sents).select("item", "zone", "sentence_index")


# ---- tokens, offsets, parses

@_sql("token_offsets", "SELECT item, zone, word, char_start, char_end::INT AS char_end FROM off", "off")
def token_offsets(spark, sf):
    return P.offsets(spark, sf)


@_sql("story_text", "SELECT item, count(*)::INT AS n_tokens, md5(string_agg(word, ' ' ORDER BY zone)) AS text_md5 FROM tok GROUP BY item", "tok")
def story_text(spark, sf):
    return align.story_text(P.tokens(spark, sf)).select("item", "n_tokens", F.md5("text").alias("text_md5"))


@_sql("sentence_number_by_period", "SELECT item, zone, sentence_id, row_number() OVER (PARTITION BY item, sentence_id ORDER BY zone)::INT AS sentence_position FROM sn", "sn")
def sentence_number_by_period(spark, sf):
    return surprisal.sentence_numbers(P.tokens(spark, sf)).drop("word")


@_sql("sentence_spans", "SELECT item, sentence_id - 1 AS sentence_index, min(char_start) AS char_start, max(char_end)::INT AS char_end, count(*)::INT AS n_zones FROM sn JOIN off USING (item, zone) GROUP BY item, sentence_id", "sn", "off")
def sentence_spans(spark, sf):
    own = align.token_offsets(_zones(spark, sf)).withColumn("g", F.col("zone") - 1)
    out = align.sentence_spans(own)
    return out.select("item", "sentence_index", "char_start", "char_end", F.size("zones").alias("n_zones"))


@_sql(
    "ptb_candidates",
    r"""SELECT form, CASE WHEN form IN ('``', '''''', '`') THEN '''|"|`' WHEN form = '''' THEN '''|' || chr(8217) || '|`' WHEN form = '"' THEN '"|' || chr(8220) || '|' || chr(8221) WHEN form = '-LRB-' THEN '('
       WHEN form = '-RRB-' THEN ')' WHEN form = '--' THEN '--|' || chr(8212) || '|' || chr(8211) ELSE form END AS candidates
       FROM (SELECT DISTINCT CASE zone % 9 WHEN 0 THEN '``' WHEN 1 THEN '''''' WHEN 2 THEN '`' WHEN 3 THEN '''' WHEN 4 THEN '"' WHEN 5 THEN '-LRB-' WHEN 6 THEN '-RRB-' WHEN 7 THEN '--' ELSE word END AS form FROM tok)""",
    "tok",
)
def ptb_candidates(spark, sf):
    shapes = ["``", "''", "`", "'", '"', "-LRB-", "-RRB-", "--"]
    form = F.coalesce(F.get(F.array(*map(F.lit, shapes)), F.pmod("zone", F.lit(9))), F.col("word"))
    return P.tokens(spark, sf, dealt=False).select(form.alias("form")).distinct().select("form", F.array_join(T.candidates(F.col("form")), "|").alias("candidates"))


@_sql("tokenid_extract", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id % 50 ELSE -1 END::INT AS item, CASE WHEN event_id % 7 <> 0 THEN event_id % 200 ELSE -1 END::INT AS zone FROM events")
def tokenid_extract(spark, sf):
    e = P.table(spark, sf, "events")
    plain, with_id = F.lit("SpaceAfter=No"), F.concat(F.lit("SpaceAfter=No|TokenId="), (F.col("event_id") % 50).cast("string"), F.lit("."), (F.col("event_id") % 200).cast("string"), F.lit(".1"))
    item, zone = T.token_id(F.when(F.col("event_id") % 7 == 0, plain).otherwise(with_id))
    return e.select("event_id", F.coalesce(item, F.lit(-1)).alias("item"), F.coalesce(zone, F.lit(-1)).alias("zone"))


@_sql(
    "align_forms",
    "SELECT item, zone, char_start, char_start + length(word) - 1 AS stem_end, char_end::INT AS char_end FROM off WHERE length(word) > 1",
    "off",
)
def align_forms(spark, sf):
    """Every word of two characters or more as two forms, its stem and its last character, found in the text."""
    off = P.offsets(spark, sf).where(F.length("word") > 1)
    n = F.length("word")
    forms = F.array(F.substring(F.col("word"), F.lit(1), n - 1), F.substring(F.col("word"), n, F.lit(1)))
    out = off.withColumn("s", align.place_forms(F.col("word"), F.lit(0), n, forms))
    at = lambda i, c: (F.col("char_start") + F.get("s", F.lit(i))[c]).alias
    return out.select("item", "zone", at(0, "char_start")("char_start"), at(0, "char_end")("stem_end"), at(1, "char_end")("char_end"))


@_sql(
    "global_gid_head",
    """SELECT doc, sentence_index, pos, g, CASE WHEN (pos + 1) // 2 > 0 THEN min(g) OVER (PARTITION BY doc, sentence_index) + (pos + 1) // 2 - 1 ELSE -1 END::INT AS head_g
       FROM (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY sentence_index, pos) - 1)::INT AS g FROM men)""",
    "men",
)
def global_gid_head(spark, sf):
    return align.numbered(P.tree(spark, sf), "doc", ["pos"]).select("doc", "sentence_index", "pos", "g", "head_g")


# ---- spans

def _span_pairs(spark, sf):
    toks = P.offsets(spark, sf).select(F.col("item").alias("doc"), "zone", F.col("char_start").alias("ts"), F.col("char_end").alias("te"))
    return spans.overlap_join(P.spans(spark, sf), toks, ["doc"], ("char_start", "char_end"), ("ts", "te"))


@_sql("overlap_join", "SELECT doc, span, zone FROM spans JOIN off ON item = doc AND char_start < ce AND char_end > cs", "spans")
def overlap_join(spark, sf):
    return _span_pairs(spark, sf).select("doc", "span", "zone")


@_sql("overlap_anti_nominals", "SELECT item AS doc, zone FROM off o WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc = o.item AND s.span % 5 = 0 AND char_start < ce AND char_end > cs)", "spans")
def overlap_anti_nominals(spark, sf):
    toks = P.offsets(spark, sf).select(F.col("item").alias("doc"), "zone", "char_start", "char_end")
    some = P.spans(spark, sf).where("span % 5 = 0")
    return spans.without_overlap(toks, some, ["doc"], ("char_start", "char_end"), ("char_start", "char_end")).select("doc", "zone")


@_sql("first_entity_label", "SELECT doc, span, arg_min(word, zone) AS label FROM spans JOIN off ON item = doc AND char_start < ce AND char_end > cs WHERE zone % 2 = 0 GROUP BY doc, span", "spans")
def first_entity_label(spark, sf):
    labels = P.offsets(spark, sf).where("zone % 2 = 0").select(F.col("item").alias("doc"), "zone", F.col("word").alias("label"), F.col("char_start").alias("ts"), F.col("char_end").alias("te"))
    pairs = spans.overlap_join(P.spans(spark, sf), labels, ["doc"], ("char_start", "char_end"), ("ts", "te"))
    return spans.first_label(pairs, ["doc", "span"], "label", ["zone"])


@_sql(
    "head_role",
    """, a AS (SELECT m.doc, m.sentence_index, w.win, pos, dep, (pos + 1) // 2 - 1 AS head FROM men m, (SELECT unnest(range(0, 1 + (SELECT max(pos) // 3 FROM men))) AS win) w WHERE pos BETWEEN 3 * win AND 3 * win + 3)
       SELECT doc, sentence_index, win::INT AS win, arg_min(dep, (CASE WHEN EXISTS (SELECT 1 FROM a b WHERE b.doc = a.doc AND b.sentence_index = a.sentence_index AND b.win = a.win AND b.pos = a.head) THEN 1000 ELSE 0 END) + pos) AS role
       FROM a GROUP BY doc, sentence_index, win""",
    "men",
)
def head_role(spark, sf):
    longest = F.max("pos").over(Window.partitionBy("doc", "sentence_index"))
    own = P.tree(spark, sf).withColumn("last", longest)
    own = own.withColumn("win", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 3).cast("int"))))
    own = own.where((F.col("pos") >= 3 * F.col("win")) & (F.col("pos") <= 3 * F.col("win") + 3))
    own = own.withColumns({"g": F.col("pos"), "head_g": F.col("head") - 1})
    return spans.head_role(own, ["doc", "sentence_index", "win"]).select("doc", "sentence_index", "win", F.col("grammatical_role").alias("role"))


ORACLE_SQL["head_role"] = ORACLE_SQL["head_role"].replace(" , a AS", ", a AS")


@_sql(
    "locate_segment",
    """, ends AS (SELECT doc_id AS doc, length(text) AS n FROM documents)
       SELECT s.doc, span, CASE WHEN ce <= n * 3 // 5 THEN 'context' WHEN cs >= n * 3 // 5 + 1 AND ce <= n * 7 // 10 THEN 'target' WHEN cs >= n * 7 // 10 + 1 AND ce <= n THEN 'post'
       WHEN (cs + ce) // 2 <= n * 3 // 5 THEN 'context' WHEN (cs + ce) // 2 BETWEEN n * 3 // 5 + 1 AND n * 7 // 10 THEN 'target' WHEN (cs + ce) // 2 BETWEEN n * 7 // 10 + 1 AND n THEN 'post' END AS segment
       FROM spans s JOIN ends e ON e.doc = s.doc""",
    "spans",
)
def locate_segment(spark, sf):
    """Where each span lies in its document's own three segments, which cover the whole text."""
    n = F.length("text")
    a, b = F.floor(n * 3 / 5).cast("int"), F.floor(n * 7 / 10).cast("int")
    parts = [("context", F.lit(0), a), ("target", a + 1, b), ("post", b + 1, n)]
    docs = P.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.array(*[F.struct(F.lit(k).alias("name"), x.alias("char_start"), y.alias("char_end")) for k, x, y in parts]).alias("segments"))
    segments = F.col("segments")
    own = P.spans(spark, sf).join(docs, "doc")
    return own.select("doc", "span", spans.locate(F.col("char_start"), F.col("char_end"), segments)["name"].alias("segment"))


ORACLE_SQL["locate_segment"] = ORACLE_SQL["locate_segment"].replace(" , ends AS", ", ends AS")


IOU = "greatest(least(a.ce, b.ce) - greatest(a.cs, b.cs), 0)"


@_sql(
    "iou_pairs",
    f"""SELECT * FROM (SELECT a.doc, a.span AS span_a, b.span AS span_b, round({IOU} / ((a.ce - a.cs) + (b.ce - b.cs) - {IOU}), 6) AS iou
        FROM (SELECT *, unnest(range(cs // 64, greatest((ce - 1) // 64, cs // 64) + 1)) AS k FROM spans) a JOIN (SELECT *, unnest(range(cs // 64, greatest((ce - 1) // 64, cs // 64) + 1)) AS k FROM spans) b
        ON a.doc = b.doc AND a.k = b.k AND a.span < b.span AND a.w <> b.w AND a.cs < b.ce AND a.ce > b.cs AND greatest(a.cs, b.cs) // 64 = a.k) WHERE iou >= 0.5""",
    "spans",
)
def iou_pairs(spark, sf):
    return spans.iou_pairs(P.spans(spark, sf)).select("doc", "span_a", "span_b", F.round("iou", 6).alias("iou"))


@_sql(
    "stitch_components",
    f""", RECURSIVE_EDGES
        SELECT s.doc, s.span, l.stitched FROM spans s JOIN (SELECT r.doc, r.w, r.cluster, min(least) AS stitched FROM reach r JOIN part p ON p.doc = r.doc AND p.w = r.rw AND p.cluster = r.rc GROUP BY ALL) l USING (doc, w, cluster)""",
    "spans",
)
def stitch_components(spark, sf):
    return windows.stitch(P.spans(spark, sf)).select("doc", "span", "stitched")


ORACLE_SQL["stitch_components"] = ORACLE_SQL["stitch_components"].replace("WITH ", "WITH RECURSIVE ", 1).replace(
    " , RECURSIVE_EDGES",
    f""", part AS (SELECT doc, w, cluster, min(span) AS least FROM spans GROUP BY ALL),
        half AS (SELECT DISTINCT a.doc, a.w AS wa, a.cluster AS ca, b.w AS wb, b.cluster AS cb FROM spans a JOIN spans b ON a.doc = b.doc AND a.span < b.span AND a.w <> b.w AND a.cs < b.ce AND a.ce > b.cs
          WHERE {IOU} / ((a.ce - a.cs) + (b.ce - b.cs) - {IOU}) >= 0.5),
        edge AS (SELECT * FROM half UNION SELECT doc, wb, cb, wa, ca FROM half),
        reach AS (SELECT doc, w, cluster, w AS rw, cluster AS rc FROM part UNION SELECT r.doc, r.w, r.cluster, e.wb, e.cb FROM reach r JOIN edge e ON e.doc = r.doc AND e.wa = r.rw AND e.ca = r.rc)""",
)


# ---- discourse

@_sql("entity_grid", "SELECT * FROM grid", "grid")
def entity_grid(spark, sf):
    own = discourse.entity_grid(P.mentions(spark, sf).withColumn("role", F.col("dep")))
    return own.select("doc", "sentence_index", "cluster", F.array_join("roles", ",").alias("roles"))


@_sql(
    "given_new",
    """SELECT doc, sentence_index, coalesce(string_agg(DISTINCT CASE WHEN first < sentence_index THEN lpad(cluster::VARCHAR, 2, '0') END, ',' ORDER BY CASE WHEN first < sentence_index THEN lpad(cluster::VARCHAR, 2, '0') END), '') AS given_entities,
       coalesce(string_agg(DISTINCT CASE WHEN first >= sentence_index THEN lpad(cluster::VARCHAR, 2, '0') END, ',' ORDER BY CASE WHEN first >= sentence_index THEN lpad(cluster::VARCHAR, 2, '0') END), '') AS new_entities
       FROM (SELECT *, min(sentence_index) OVER (PARTITION BY doc, cluster) AS first FROM men) GROUP BY doc, sentence_index""",
    "men",
)
def given_new(spark, sf):
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(x.cast("string"), 2, "0")), ",").alias(c)
    return discourse.given_new(P.mentions(spark, sf)).select("doc", "sentence_index", flat("given_entities"), flat("new_entities"))


@_sql("cluster_first_sentence", "SELECT doc, cluster, min(sentence_index) AS first_sentence, count(*) AS n_mentions FROM men GROUP BY ALL", "men")
def cluster_first_sentence(spark, sf):
    return discourse.first_sentences(P.mentions(spark, sf))


def _turns(spark, sf):
    return P.table(spark, sf, "conversations").select("conv_id", "turn", "text")


@_sql("context_full", "SELECT conv_id, turn, md5(coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS context_md5 FROM conversations")
def context_full(spark, sf):
    return discourse.rows_context(_turns(spark, sf), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("context").alias("context_md5"))


@_sql("context_last_k", "SELECT conv_id, turn, md5(coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS context_md5 FROM conversations")
def context_last_k(spark, sf):
    return discourse.rows_context(_turns(spark, sf), "conv_id", "turn", "text", 2).select("conv_id", "turn", F.md5("context").alias("context_md5"))


@_sql(
    "context_slice",
    """, s AS (SELECT item AS doc, sentence_id - 1 AS sentence_index, min(char_start) AS cs, max(char_end) AS ce FROM sn JOIN off USING (item, zone) GROUP BY ALL),
       t AS (SELECT item AS doc, string_agg(word, ' ' ORDER BY zone) AS text FROM tok GROUP BY item),
       b AS (SELECT *, CASE WHEN sentence_index = 0 THEN 0 ELSE coalesce(lag(cs, 2) OVER w, first_value(cs) OVER w) END AS f FROM s WINDOW w AS (PARTITION BY doc ORDER BY sentence_index))
       SELECT doc, sentence_index, md5(trim(substr(text, f + 1, greatest(cs - f, 0)::BIGINT))) AS context_md5 FROM b JOIN t USING (doc)""",
    "sn", "off",
)
def context_slice(spark, sf):
    sents = _sentence_texts(align.token_offsets(_zones(spark, sf)).withColumnRenamed("item", "doc"))
    out = discourse.rows_context(sents, "doc", "sentence_index", "text", 2)
    return out.select("doc", "sentence_index", F.md5(T.strip(F.col("context"))).alias("context_md5"))


def _sentence_texts(toks):
    """Sentences (doc, sentence_index, char_start, char_end, token_gids) with their own text, of which text_start is the place."""
    token = F.struct("zone", "word")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda t: t["word"]), " ")
    gids = F.array_sort(F.collect_list(F.col("zone") - 1))
    out = toks.groupBy("doc", "sentence_index").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), text.alias("text"), gids.alias("token_gids"))
    return out.withColumn("text_start", F.col("char_start"))


ORACLE_SQL["context_slice"] = ORACLE_SQL["context_slice"].replace(" , s AS", ", s AS")


@_sql(
    "turn_sep_concat",
    """SELECT conv_id, turn, length(c) AS target_start, length(c) + length(t) AS target_end, length(c) + length(t) + (t <> '')::INT + length(p) AS total,
       md5(rtrim(c || t || CASE WHEN t <> '' THEN ' ' ELSE '' END || p)) AS text_md5 FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t, coalesce(nullif(lag(replace(text, chr(10), ' ')) OVER w, '') || ' ', '') AS c,
       coalesce(lead(replace(text, chr(10), ' ')) OVER w, '') AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
)
def turn_sep_concat(spark, sf):
    plain = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    turns = _turns(spark, sf).withColumn("target", plain)
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = turns.withColumns({"context": F.lag("target").over(w), "post": F.lead("target").over(w)})
    text, places = discourse.join_segments([("context", F.col("context")), ("target", F.col("target")), ("post_context", F.col("post"))])
    own = own.withColumn("p", places)
    at = lambda i, c: F.get("p", F.lit(i))[c].cast("long")
    return own.select("conv_id", "turn", at(1, "char_start").alias("target_start"), at(1, "char_end").alias("target_end"), at(2, "char_end").alias("total"), F.md5(text).alias("text_md5"))


@_sql(
    "target_mentions",
    """, s AS (SELECT item AS doc, sentence_id - 1 AS sentence_index, min(char_start) AS a, max(char_end) AS b FROM sn JOIN off USING (item, zone) GROUP BY ALL),
       t AS (SELECT item AS doc, string_agg(word, ' ' ORDER BY zone) AS text FROM tok GROUP BY item),
       m AS (SELECT x.*, sentence_id - 1 AS sentence_index FROM spans x JOIN sn ON item = doc AND zone = span)
       SELECT doc, sentence_index, span, (cs - a)::INT AS char_start, least(ce, b)::INT - a AS char_end, substr(text, cs + 1, least(ce, b)::BIGINT - cs) AS mention_text FROM m JOIN s USING (doc, sentence_index) JOIN t USING (doc)""",
    "spans", "sn",
)
def target_mentions(spark, sf):
    toks = align.token_offsets(_zones(spark, sf)).withColumnRenamed("item", "doc")
    place = toks.select("doc", F.col("zone").cast("long").alias("span"), "sentence_index")
    found = P.spans(spark, sf).join(place.hint("merge"), ["doc", "span"])
    return discourse.target_mentions(found, _sentence_texts(toks)).select("doc", "sentence_index", "span", "char_start", "char_end", "mention_text")


ORACLE_SQL["target_mentions"] = ORACLE_SQL["target_mentions"].replace(" , s AS", ", s AS")


# ---- windows and surprisal

def _sentence_words(spark, sf):
    return _zones(spark, sf).groupBy(F.col("item").alias("doc"), "sentence_index").agg(F.count("*").alias("n_words"))


@_sql(
    "window_packing",
    """, z AS (SELECT item AS doc, sentence_index AS i, count(*) AS n FROM zones GROUP BY ALL), m AS (SELECT doc, max(i) AS last FROM z GROUP BY doc),
       r AS (SELECT a.doc, a.i AS first, greatest(a.i, coalesce(max(CASE WHEN b.total <= 40 THEN b.i END), a.i)) AS reach FROM z a JOIN (SELECT x.doc, x.i AS f, y.i, sum(y.n) OVER (PARTITION BY x.doc, x.i ORDER BY y.i) AS total
         FROM z x JOIN z y ON x.doc = y.doc AND y.i >= x.i) b ON b.doc = a.doc AND b.f = a.i GROUP BY a.doc, a.i),
       w AS (SELECT r.doc, 0 AS win, first, reach FROM r WHERE first = 0 UNION ALL SELECT w.doc, w.win + 1, r.first, r.reach FROM w JOIN m ON m.doc = w.doc AND w.reach < m.last JOIN r ON r.doc = w.doc AND r.first = greatest(w.first + 1, w.reach + 1 - 2))
       SELECT w.doc, win::INT AS win, first::INT AS first_sentence, reach::INT AS last_sentence, sum(n)::BIGINT AS n_words FROM w JOIN z ON z.doc = w.doc AND z.i BETWEEN first AND reach GROUP BY ALL""",
    "zones",
)
def window_packing(spark, sf):
    return windows.pack_windows(_sentence_words(spark, sf), 40, 2).withColumnRenamed("window", "win")


ORACLE_SQL["window_packing"] = ORACLE_SQL["window_packing"].replace("WITH ", "WITH RECURSIVE ", 1).replace(" , z AS", ", z AS")


def _pieces(spark, sf):
    return P.tokens(spark, sf).select("item", (F.col("zone") - 1).alias("i"), (1 + F.floor(F.length("word") / 6)).cast("int").alias("pieces"))


@_sql(
    "lm_context_window",
    """, x AS (SELECT item, zone - 1 AS i, 1 + length(word) // 6 AS n FROM tok), c AS (SELECT item, i, sum(n) OVER (PARTITION BY item ORDER BY i) AS upto, n FROM x),
       j AS (SELECT a.item, a.i, b.i AS c, sum(b.n) OVER (PARTITION BY a.item, a.i ORDER BY b.i DESC) AS held, b.n FROM x a JOIN x b ON a.item = b.item AND b.i < a.i AND b.i > a.i - 12)
       SELECT x.item, x.i, coalesce(min(j.c), x.i)::BIGINT AS context_first, coalesce(sum(j.n), 0)::BIGINT AS context_pieces FROM x LEFT JOIN j ON j.item = x.item AND j.i = x.i AND j.held - j.n < 12 GROUP BY x.item, x.i""",
    "tok",
)
def lm_context_window(spark, sf):
    return surprisal.context_windows(_pieces(spark, sf), 12).select("item", "i", "context_first", "context_pieces")


ORACLE_SQL["lm_context_window"] = ORACLE_SQL["lm_context_window"].replace(" , x AS", ", x AS")


def _subwords(spark, sf):
    off = P.tokens(spark, sf)
    rows = off.select("item", "zone", F.posexplode(F.split(F.regexp_replace("word", r"(.{4})", "$1\u0001"), "\u0001")).alias("part", "piece")).where("piece <> '' OR part = 0")
    i = F.row_number().over(Window.partitionBy("item").orderBy("zone", "part"))
    token = F.concat(F.when(F.col("part") == 0, "Ġ").otherwise(""), F.col("piece"))
    return rows.select("item", i.alias("i"), token.alias("token"), (-F.length("piece") / F.lit(8.0)).alias("score"))


@_sql(
    "subword_to_word",
    "SELECT item, zone AS word_index, round(length(word) / 8.0, 6) AS surprisal, greatest(1, CEIL(length(word) / 4.0))::BIGINT AS n_pieces FROM tok",
    "tok",
)
def subword_to_word(spark, sf):
    out = surprisal.word_scores(_subwords(spark, sf), ["item"])
    return out.select("item", "word_index", F.round("surprisal", 6).alias("surprisal"), "n_pieces")


# ---- distances

def _sides(spark, sf):
    return P.sides(spark, sf), P.targets(spark, sf, dealt=True)


def _rounded(df):
    return df.select("doc", "i", "k", F.round("distance", 6).alias("distance"))


@_sql(
    "iv_entity_set",
    """, o AS (SELECT DISTINCT doc, i, k, cluster FROM targ WHERE givenness = 'given'), n AS (SELECT doc, i, k, count(*) AS n FROM o GROUP BY ALL),
       c AS (SELECT a.doc, a.i, a.k, count(*) AS common FROM o a JOIN o g ON g.doc = a.doc AND g.i = a.i AND g.k = 0 AND g.cluster = a.cluster WHERE a.k > 0 GROUP BY ALL)
       SELECT s.doc, s.i, s.k, round(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 0 ELSE 1 - coalesce(common, 0)::DOUBLE / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(common, 0)) END, 6) AS distance
       FROM sides s LEFT JOIN n x ON x.doc = s.doc AND x.i = s.i AND x.k = 0 LEFT JOIN n y ON y.doc = s.doc AND y.i = s.i AND y.k = s.k LEFT JOIN c ON c.doc = s.doc AND c.i = s.i AND c.k = s.k WHERE s.k > 0""",
    "sides", "targ",
)
def iv_entity_set(spark, sf):
    s, t = _sides(spark, sf)
    return _rounded(distance.entity_set(t, s, DEALT))


ORACLE_SQL["iv_entity_set"] = ORACLE_SQL["iv_entity_set"].replace(" , o AS", ", o AS")
_FEATURE_SQL = "SELECT s.doc, s.i, s.k, round(coalesce(d, 0), 6) AS distance FROM sides s LEFT JOIN (SELECT doc, i, k, CASE WHEN sum({g}) = 0 OR sum({a}) = 0 THEN 1 ELSE {d} END AS d FROM ga GROUP BY doc, i, k) USING (doc, i, k) WHERE s.k > 0"


@_sql("iv_feature_l1", _FEATURE_SQL.format(g="g", a="a", d="sum(abs(g - a)) / 2"), "pairs")
def iv_feature_l1(spark, sf):
    s, t = _sides(spark, sf)
    return _rounded(distance.feature_l1(distance.feature_vectors(t, DEALT), s, DEALT))


@_sql("iv_feature_js", _FEATURE_SQL.format(g="g", a="a", d="sqrt(greatest(sum(CASE WHEN g > 0 THEN g * log2(g / ((g + a) / 2)) ELSE 0 END + CASE WHEN a > 0 THEN a * log2(a / ((g + a) / 2)) ELSE 0 END) / 2, 0))"), "pairs")
def iv_feature_js(spark, sf):
    s, t = _sides(spark, sf)
    return _rounded(distance.feature_js(distance.feature_vectors(t, DEALT), s, DEALT))


@_sql("iv_weighted_l1", _FEATURE_SQL.format(g="wg", a="wa", d="sum(abs(wg - wa)) / 2"), "pairs")
def iv_weighted_l1(spark, sf):
    s, t = _sides(spark, sf)
    return _rounded(distance.feature_l1(distance.feature_vectors(t, DEALT, weighted=True), s, DEALT))


def _variant(feature: str, where: str = "true") -> str:
    return TABLES["feat"].replace("cluster::VARCHAR END || '|' || givenness || '|' || form || '|' || role AS feature", feature).replace("FROM targ)", f"FROM targ WHERE {where})")


for _name, _feature, _where in (
    ("recurrence", "cluster::VARCHAR END AS feature", "true"),
    ("role_form", "cluster::VARCHAR END AS e, role || '|' || form || '|' || e AS feature", "true"),
    ("role_form_no_other", "cluster::VARCHAR END AS e, role || '|' || form || '|' || e AS feature", "role <> 'other'"),
    ("role_only", "cluster::VARCHAR END AS e, role || '|' || e AS feature", "true"),
    ("backoff", "cluster::VARCHAR END AS e, unnest(['0|' || e, '1|' || e || '|' || form, '2|' || e || '|' || role, '3|' || e || '|' || givenness || '|' || form || '|' || role]) AS feature", "true"),
):

    def _feature_variant(spark, sf, name=_name):
        s, t = _sides(spark, sf)
        return _rounded(distance.feature_l1(distance.feature_vectors(t, DEALT, name), s, DEALT))

    QUERIES[f"iv_{_name}"] = _feature_variant
    ORACLE_SQL[f"iv_{_name}"] = ORACLE_SQL["iv_feature_l1"].replace(TABLES["feat"], _variant(_feature, _where))


@_sql(
    "iv_new_entity",
    """, n AS (SELECT doc, i, k, count(DISTINCT cluster) AS n FROM targ WHERE givenness = 'new' GROUP BY ALL)
       SELECT s.doc, s.i, s.k, abs(coalesce(x.n, 0) - coalesce(y.n, 0))::DOUBLE AS distance FROM sides s LEFT JOIN n x ON x.doc = s.doc AND x.i = s.i AND x.k = 0 LEFT JOIN n y ON y.doc = s.doc AND y.i = s.i AND y.k = s.k WHERE s.k > 0""",
    "sides", "targ",
)
def iv_new_entity(spark, sf):
    s, t = _sides(spark, sf)
    return _rounded(distance.new_entities(t, s, DEALT))


ORACLE_SQL["iv_new_entity"] = ORACLE_SQL["iv_new_entity"].replace(" , n AS", ", n AS")
_TRANSITION = """, q AS (SELECT doc, i, cluster, max((role = 'subject')::INT) AS ws, max((role = 'object')::INT) AS wo FROM prev GROUP BY ALL), h AS (SELECT DISTINCT doc, i FROM prev WHERE role = 'subject'),
  f AS (SELECT t.doc, t.i, t.k, bool_or(role = 'subject' AND coalesce(wo, 0) = 1 AND coalesce(ws, 0) = 0) AS f1, bool_or(role = 'subject' AND coalesce(ws, 0) = 1) AS f2, bool_or(role = 'subject' AND givenness = 'given' AND form = 'pronoun') AS f3,
    bool_or(role = 'subject' AND givenness = 'given' AND form = 'definite_np') AS f4, bool_or(role <> 'subject' AND givenness = 'given' AND form = 'definite_np') AS f5, bool_or(givenness <> 'given' AND etype = 'person') AS f6,
    bool_or(givenness <> 'given') AS anynew, bool_or(givenness = 'given') AS anygiven FROM targ t LEFT JOIN q USING (doc, i, cluster) GROUP BY ALL),
  z AS (SELECT s.doc, s.i, s.k, CASE WHEN f1 THEN 'old_object_becomes_subject' WHEN f2 THEN 'old_subject_continues' WHEN f3 THEN 'given_pronoun_subject' WHEN f4 THEN 'given_definite_subject' WHEN f5 THEN 'accessible_definite_np'
    WHEN f6 THEN 'new_person_introduced' WHEN anynew AND NOT anygiven THEN 'only_new_entities' WHEN h.doc IS NOT NULL THEN 'previous_subject_dropped' ELSE 'other' END AS transition
    FROM sides s LEFT JOIN f USING (doc, i, k) LEFT JOIN h ON h.doc = s.doc AND h.i = s.i) """


def _transitions(spark, sf):
    s, t = P.sides(spark, sf).drop("block"), P.targets(spark, sf)
    return distance.transition_class(t, s, P.before(spark, sf), KEYS)


@_sql("iv_transition_class", _TRANSITION + "SELECT * FROM z", "sides", "targ", "prev")
def iv_transition_class(spark, sf):
    return _transitions(spark, sf)


@_sql(
    "iv_transition_surprisal",
    _TRANSITION + "SELECT a.doc, a.i, count(*) AS n, sum((a.transition = g.transition)::INT)::BIGINT AS same, round(-ln((sum((a.transition = g.transition)::INT) + 1.0) / (count(*) + 9.0)), 6) AS surprisal FROM z a JOIN z g ON g.doc = a.doc AND g.i = a.i AND g.k = 0 WHERE a.k > 0 GROUP BY a.doc, a.i",
    "sides", "targ", "prev",
)
def iv_transition_surprisal(spark, sf):
    out = distance.transition_surprisal(_transitions(spark, sf), KEYS)
    return out.select("doc", "i", "n", "same", F.round("surprisal", 6).alias("surprisal"))


for _name in ("iv_transition_class", "iv_transition_surprisal"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(" , q AS", ", q AS")


@_sql(
    "iv_graph",
    """, e AS (SELECT doc, i, past, cluster, max(CASE role WHEN 'subject' THEN 3.0 WHEN 'object' THEN 2.0 ELSE 1.0 END) AS c FROM ctx GROUP BY ALL),
       b AS (SELECT doc, i, k, cluster, max(CASE role WHEN 'subject' THEN 3.0 WHEN 'object' THEN 2.0 ELSE 1.0 END) AS w FROM targ GROUP BY ALL),
       v AS (SELECT doc, i, k, past, sum(w * c) AS x FROM b JOIN e USING (doc, i, cluster) GROUP BY ALL),
       ga AS (SELECT doc, i, k, past, sum(g) AS g, sum(a) AS a FROM (SELECT s.doc, s.i, s.k, past, x AS g, 0 AS a FROM sides s JOIN v ON v.doc = s.doc AND v.i = s.i AND v.k = 0 WHERE s.k > 0 UNION ALL SELECT doc, i, k, past, 0, x FROM v WHERE k > 0) GROUP BY ALL)
       SELECT s.doc, s.i, s.k, round(coalesce(d, 0), 6) AS distance FROM sides s LEFT JOIN (SELECT doc, i, k, (sum(abs(g - a)) / (sum(g) + sum(a) + 1e-9))::DOUBLE AS d FROM ga GROUP BY ALL) USING (doc, i, k) WHERE s.k > 0""",
    "sides", "targ", "ctx",
)
def iv_graph(spark, sf):
    s, t = _sides(spark, sf)
    return _rounded(distance.graph_distance(t, s, P.context(spark, sf), DEALT, scope=["doc"], at="i"))


ORACLE_SQL["iv_graph"] = ORACLE_SQL["iv_graph"].replace(" , e AS", ", e AS")


@_sql("iv_mean_p80", "SELECT doc, i, count(*) AS n, round(avg(distance), 6) AS mean, round(quantile_cont(distance, 0.8), 6) AS p80 FROM (" + ORACLE_SQL["iv_feature_l1"] + ") GROUP BY doc, i")
def iv_mean_p80(spark, sf):
    out = distance.aggregate_alternatives(iv_feature_l1(spark, sf), KEYS)
    return out.select("doc", "i", "n", F.round("mean", 6).alias("mean"), F.round("p80", 6).alias("p80"))


@_sql("iv_combined", "SELECT f.doc, f.i, f.k, f.distance AS feature, g.distance AS graph, round(0.5 * f.distance + 0.5 * g.distance, 9) AS distance FROM (" + ORACLE_SQL["iv_feature_l1"] + ") f JOIN (" + ORACLE_SQL["iv_graph"] + ") g USING (doc, i, k)")
def iv_combined(spark, sf):
    out = distance.combined({"feature": (iv_feature_l1(spark, sf), 0.5), "graph": (iv_graph(spark, sf), 0.5)}, KEYS)
    return out.withColumn("distance", F.round("distance", 9))


@_sql(
    "ot_pair_cost",
    """SELECT a.doc, a.i, b.k, a.cluster AS ca, b.cluster AS cb, count(*) AS n, round(sum(0.2 * ((a.cluster <> b.cluster)::INT + (a.givenness <> b.givenness)::INT + (a.form <> b.form)::INT + (a.role <> b.role)::INT + (a.text <> b.text)::INT)), 6)::DOUBLE AS cost
       FROM targ a JOIN targ b ON a.doc = b.doc AND a.i = b.i AND a.k = 0 AND b.k > 0 GROUP BY ALL""",
    "targ",
)
def ot_pair_cost(spark, sf):
    t = P.targets(spark, sf)
    names = ("cluster", "givenness", "form", "role", "text")
    a = t.where("k = 0").select(*KEYS, *[F.col(c).alias(f"a_{c}") for c in names])
    b = t.where("k > 0").select(*KEYS, "k", *[F.col(c).alias(f"b_{c}") for c in names])
    pairs = a.join(b, KEYS).withColumn("cost", distance.pair_cost())
    return pairs.groupBy(*KEYS, "k", F.col("a_cluster").alias("ca"), F.col("b_cluster").alias("cb")).agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@_sql("ot_distance", None)
def ot_distance(spark, sf):
    """The solver is beyond SQL; tests hold it against all matchings."""
    s, t = _sides(spark, sf)
    return _rounded(distance.transport_distance(t, s, DEALT))


# ---- statistics

@_sql("zscore", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS price_z, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS quantity_z FROM lineitem")
def zscore(spark, sf):
    own = stats.z_scores(P.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], "_z")
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice_z", 6).alias("price_z"), F.round("l_quantity_z", 6).alias("quantity_z"))


@_sql(
    "analysis_merge",
    """, f AS (SELECT item, zone, length(word) AS freq FROM tok WHERE zone % 3 = 0), s AS (SELECT item, zone, sentence_id, length(word) / 2.0 AS surprisal FROM sn), iv AS (SELECT item, sentence_id, count(*)::DOUBLE AS iv FROM sn WHERE sentence_id % 2 = 0 GROUP BY ALL)
       SELECT event_id, item, zone, rt, coalesce(surprisal, -1)::DOUBLE AS surprisal, round(coalesce(ln(freq + 1), -1), 6) AS log_freq, coalesce(iv, -1) AS iv FROM rt LEFT JOIN s USING (item, zone) LEFT JOIN f USING (item, zone) LEFT JOIN iv USING (item, sentence_id)""",
    "rt", "sn",
)
def analysis_merge(spark, sf):
    toks = surprisal.sentence_numbers(P.tokens(spark, sf))
    s = toks.select("item", "zone", "sentence_id", (F.length("word") / 2.0).alias("surprisal"))
    f = toks.where("zone % 3 = 0").select("item", "zone", F.length("word").alias("freq"))
    iv = toks.where("sentence_id % 2 = 0").groupBy("item", "sentence_id").agg(F.count("*").cast("double").alias("iv"))
    out = stats.log_frequency(stats.analysis_table(P.events_rt(spark, sf), s, f, iv))
    gap = lambda c: F.coalesce(c, F.lit(-1.0))
    return out.select("event_id", "item", "zone", "rt", gap("surprisal").alias("surprisal"), F.round(gap("log_freq"), 6).alias("log_freq"), gap("iv").alias("iv"))


ORACLE_SQL["analysis_merge"] = ORACLE_SQL["analysis_merge"].replace(" , f AS", ", f AS")


@_sql("cell_means", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY ALL")
def cell_means(spark, sf):
    out = stats.cell_means(P.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_tax")
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])


@_sql(
    "log_histogram",
    """SELECT bin, count(*) AS n FROM (SELECT least(floor((ln(value) - lo) / ((hi - lo) / 30)), 29)::INT + 1 AS bin FROM events, (SELECT min(ln(value)) AS lo, max(ln(value)) AS hi FROM events WHERE value > 0) WHERE value > 0) GROUP BY bin""",
)
def log_histogram(spark, sf):
    return stats.log_histogram(P.table(spark, sf, "events"), "value").select("bin", "n")


@_sql("ols_gram", "SELECT l_returnflag, count(*)::DOUBLE AS n, round(sum(l_quantity), 2) AS sx, round(sum(l_quantity * l_quantity), 2) AS sxx, round(sum(ln(l_extendedprice)), 4) AS sy, round(sum(l_quantity * ln(l_extendedprice)), 4) AS sxy FROM lineitem GROUP BY l_returnflag")
def ols_gram(spark, sf):
    own = P.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*stats._moments(F.log("l_extendedprice"), [F.col("l_quantity")]))
    return own.select("l_returnflag", F.col("m0_0").alias("n"), F.round("m0_1", 2).alias("sx"), F.round("m1_1", 2).alias("sxx"), F.round("m0_2", 4).alias("sy"), F.round("m1_2", 4).alias("sxy"))


@_sql("ols_fit", "SELECT round(regr_intercept(ln(l_extendedprice), l_quantity), 5) AS intercept, round(regr_slope(ln(l_extendedprice), l_quantity), 6) AS slope, count(*)::DOUBLE AS n FROM lineitem")
def ols_fit(spark, sf):
    fit = stats.linear_fit(P.table(spark, sf, "lineitem"), F.log("l_extendedprice"), {"quantity": F.col("l_quantity")})
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 5), round(float(fit.coefficients[1]), 6), float(fit.n))], "intercept double, slope double, n double")


@_sql(
    "loo_folds",
    """, a AS (SELECT l_returnflag AS fold, ln(l_extendedprice) AS y, l_quantity AS x FROM lineitem), k AS (SELECT DISTINCT fold FROM a),
       b AS (SELECT k.fold, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM k JOIN a ON a.fold <> k.fold GROUP BY k.fold)
       SELECT fold, count(*)::DOUBLE AS n, round(avg((y - i - s * x) * (y - i - s * x)), 5) AS mse FROM a JOIN b USING (fold) GROUP BY fold""",
)
def loo_folds(spark, sf):
    out = stats.leave_one_out(P.table(spark, sf, "lineitem"), "l_returnflag", F.log("l_extendedprice"), {"quantity": F.col("l_quantity")})
    return spark.createDataFrame([(r["fold"], float(r["n"]), round(float(r["mse"]), 5)) for r in out], "fold string, n double, mse double")


ORACLE_SQL["loo_folds"] = "WITH " + ORACLE_SQL["loo_folds"].removeprefix(", ")


@_sql("mixed_model", None)
def mixed_model(spark, sf):
    """Likelihood-ratio test of a mixed model; iterative, so beyond SQL; tests hold it against a dense likelihood."""
    own = P.table(spark, sf, "lineitem").join(P.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    y, x = F.log("l_extendedprice"), {"quantity": F.col("l_quantity")}
    small, large = stats.mixed_fit(own, y, {}, "s_nationkey"), stats.mixed_fit(own, y, x, "s_nationkey")
    test = stats.likelihood_ratio(small, large)
    row = (float(large.coefficients[0]), float(large.coefficients[1]), large.sigma, large.group_sigma, float(test["chi_square"]), int(test["df"]), float(test["p"]))
    return spark.createDataFrame([row], "intercept double, slope double, sigma double, group_sigma double, chi_square double, df int, p double")


def _priced(spark, sf):
    return P.table(spark, sf, "lineitem").join(P.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))


@_sql("mixed_reml", None)
def mixed_reml(spark, sf):
    """One model by both criteria; iterative, so beyond SQL; tests hold it against dense likelihoods."""
    fit = mixed.intercept_fit(_priced(spark, sf), F.log("l_extendedprice"), {"quantity": F.col("l_quantity")}, "s_nationkey")
    rows = [(n, float(f.coefficients[0]), float(f.coefficients[1]), f.sigma, f.group_sigma, float(f.log_likelihood)) for n, f in (("reml", fit.reml), ("ml", fit.ml))]
    return spark.createDataFrame(rows, "criterion string, intercept double, slope double, sigma double, group_sigma double, log_likelihood double")


@_sql("mixed_crossed", None)
def mixed_crossed(spark, sf):
    """Random intercepts of nations and parts, which cross; tests hold the fit against a dense likelihood."""
    fit = mixed.crossed_fit(_priced(spark, sf), F.log("l_extendedprice"), {"quantity": F.col("l_quantity")}, ("s_nationkey", "l_partkey"))
    row = (float(fit.coefficients[0]), float(fit.coefficients[1]), fit.sigma, *map(float, fit.group_sigma), float(fit.log_likelihood))
    return spark.createDataFrame([row], "intercept double, slope double, sigma double, nation_sigma double, part_sigma double, log_likelihood double")


@_sql("mixed_gamma", None)
def mixed_gamma(spark, sf):
    """Gamma model of prices with an intercept for each nation; tests hold it against numerical integrals."""
    fit = mixed.gamma_intercept_fit(_priced(spark, sf), "l_extendedprice", ["l_quantity"], "s_nationkey")
    row = (float(fit.coefficients[0]), float(fit.coefficients[1]), fit.sigma, fit.group_sigma, float(fit.log_likelihood))
    return spark.createDataFrame([row], "intercept double, slope double, sigma double, group_sigma double, log_likelihood double")


@_sql(
    "mixed_held_out",
    """, a AS (SELECT l_returnflag AS f, l_suppkey AS g, ln(l_extendedprice) AS y, l_quantity::DOUBLE AS x FROM lineitem),
       c AS (SELECT f, g, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM a GROUP BY f, g),
       k AS (SELECT DISTINCT f AS k FROM a UNION ALL SELECT '*'),
       s AS (SELECT k, g, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM k JOIN c ON f <> k GROUP BY k, g),
       m AS (SELECT k, sum(n) AS n, sum(n - w * n * n) AS a11, sum(sx - w * n * sx) AS a12, sum(sxx - w * sx * sx) AS a22, sum(sy - w * n * sy) AS b1, sum(sxy - w * sx * sy) AS b2, sum(syy - w * sy * sy) AS yy,
         sum(ln(1 + 0.5 * n)) AS ld FROM (SELECT *, 0.5 / (1 + 0.5 * n) AS w FROM s) GROUP BY k),
       b AS (SELECT *, (b1 - a12 * slope) / a11 AS cut FROM (SELECT *, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS slope FROM m)),
       v AS (SELECT *, (yy - cut * b1 - slope * b2) / n AS var FROM b),
       e AS (SELECT v.k AS fold, t.n - v.n AS n, -0.5 * ((t.n - v.n) * ln(2 * pi() * v.var) + t.ld - v.ld + (t.yy - 2 * (v.cut * t.b1 + v.slope * t.b2) + v.cut * v.cut * t.a11 + 2 * v.cut * v.slope * t.a12 + v.slope * v.slope * t.a22) / v.var - v.n) AS ll
         FROM v JOIN v t ON t.k = '*' AND v.k <> '*')
       SELECT fold, n, round(ll, 3) AS log_likelihood FROM e""",
)
def mixed_held_out(spark, sf):
    """Log-likelihood of each fold given the others, half of the residual variance between suppliers."""
    out = mixed.held_out(P.table(spark, sf, "lineitem"), "l_returnflag", F.log("l_extendedprice"), {"quantity": F.col("l_quantity")}, "l_suppkey", ratio=0.5)
    return spark.createDataFrame([(r["fold"], float(r["n"]), round(float(r["log_likelihood"]), 3)) for r in out], "fold string, n double, log_likelihood double")


ORACLE_SQL["mixed_held_out"] = "WITH " + ORACLE_SQL["mixed_held_out"].removeprefix(", ")


# ---- audit

@_sql(
    "chain_ledger",
    "SELECT doc, cluster, count(*) AS n_mentions, min(sentence_index) AS first_sentence, max(sentence_index) AS last_sentence FROM men GROUP BY doc, cluster HAVING count(*) > 1",
    "men",
)
def chain_ledger(spark, sf):
    return audit.chain_inventory(P.mentions(spark, sf)).where("NOT singleton").select("doc", "cluster", "n_mentions", "first_sentence", "last_sentence")


@_sql(
    "chain_color_rank",
    """SELECT doc, cluster, r AS chain_rank, round((r * 137.508) % 360, 1)::DOUBLE AS hue FROM (SELECT doc, cluster, (row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) - 1)::INT AS r
       FROM (SELECT doc, cluster, count(*) AS n, min(sentence_index * 1000 + pos) AS f FROM men GROUP BY ALL HAVING count(*) > 1))""",
    "men",
)
def chain_color_rank(spark, sf):
    return audit.chain_inventory(P.mentions(spark, sf)).where("NOT singleton").select("doc", "cluster", "chain_rank", "hue")


@_sql("singletons", "SELECT doc, cluster, min(sentence_index) AS sentence_index FROM men GROUP BY doc, cluster HAVING count(*) = 1", "men")
def singletons(spark, sf):
    return audit.chain_inventory(P.mentions(spark, sf)).where("singleton").select("doc", "cluster", F.col("first_sentence").alias("sentence_index"))


@_sql(
    "rep_head",
    r"""SELECT doc, cluster, arg_max(h, n * 1000000 - f) AS head FROM (SELECT doc, cluster, h, count(*) AS n, min(sentence_index * 1000 + pos) AS f
        FROM (SELECT *, string_split(lower(text), ' ')[-1] AS h FROM men) GROUP BY ALL) GROUP BY doc, cluster""",
    "men",
)
def rep_head(spark, sf):
    own = P.mentions(spark, sf).withColumn("at", F.col("sentence_index") * 1000 + F.col("pos"))
    return audit.representative_heads(own, ["doc", "cluster"], order="at")


@_sql("corpus_totals", "SELECT count(DISTINCT doc) AS n_docs, count(*) AS n_clusters, sum(n)::BIGINT AS n_mentions, sum((n = 1)::INT)::BIGINT AS n_singletons FROM (SELECT doc, cluster, count(*) AS n FROM men GROUP BY ALL)", "men")
def corpus_totals(spark, sf):
    return audit.corpus_totals(P.mentions(spark, sf))


@_sql("nested_html", None)
def nested_html(spark, sf):
    """Sentences as nested spans; a stack is beyond SQL; tests hold it against worked examples."""
    own = P.spans(spark, sf)
    # What tells mentions apart is collected, the rest follows from it.
    m = own.select("doc", F.struct("char_start", "char_end", "cluster").alias("m")).groupBy("doc").agg(F.sort_array(F.collect_list("m")).alias("m"))
    m = m.select("doc", F.transform("m", lambda x: F.struct(*_mention_fields(x))).alias("mentions"))
    texts = align.story_text(P.tokens(spark, sf)).select(F.col("item").alias("doc"), "text")
    none = F.array().cast("array<struct<char_start: int, char_end: int>>")
    return audit.render_sentences(texts.join(m.hint("merge"), "doc").withColumns({"sentence_index": F.lit(0), "uncovered": none}))


def _mention_fields(m):
    cluster, none = m["cluster"], F.lit(None).cast("string")
    return [
        m["char_start"].cast("int").alias("char_start"), m["char_end"].cast("int").alias("char_end"), cluster.alias("cluster"), F.lit(2).alias("n_mentions"), F.lit(False).alias("singleton"),
        F.round(F.pmod(cluster * F.lit(audit.HUE_STEP), F.lit(360.0)), 1).alias("hue"), F.lit("nsubj").alias("role"), none.alias("ner_label"), F.lit("given").alias("status"), none.alias("source"),
    ]


# ---- annotation tables

@_sql(
    "annotation_islands",
    """, r AS (SELECT item, zone, CASE WHEN length(word) % 4 < 2 THEN length(word) % 4 END AS cluster, sentence_id FROM sn),
       g AS (SELECT *, zone - row_number() OVER (PARTITION BY item, sentence_id, cluster ORDER BY zone) AS island FROM r WHERE cluster IS NOT NULL)
       SELECT item, sentence_id, cluster::INT AS cluster, min(zone) AS first_zone, max(zone) AS last_zone, count(*) AS n FROM g GROUP BY item, sentence_id, cluster, island""",
    "sn",
)
def annotation_islands(spark, sf):
    from ..sources.annotation import mention_runs

    own = surprisal.sentence_numbers(P.tokens(spark, sf)).withColumn("cluster", F.when(F.length("word") % 4 < 2, F.length("word") % 4))
    out = mention_runs(own, ["item", "sentence_id"], "zone", "cluster")
    return out.select("item", "sentence_id", "cluster", F.col("first").alias("first_zone"), F.col("last").alias("last_zone"), "n")


ORACLE_SQL["annotation_islands"] = ORACLE_SQL["annotation_islands"].replace(" , r AS", ", r AS")


@_sql(
    "split_antecedent_explode",
    "SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN [(event_id % 20)::INT] ELSE [(event_id % 20)::INT, (event_id % 7)::INT + 20] END) AS cluster FROM events",
)
def split_antecedent_explode(spark, sf):
    from ..sources.annotation import antecedents

    a, b = (F.col("event_id") % 20).cast("string"), (F.col("event_id") % 7 + 20).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, a).when(F.col("event_id") % 3 == 1, F.concat(a, F.lit("+"), b)).otherwise(F.concat(a, F.lit("-"), b))
    return P.table(spark, sf, "events").select("event_id", F.explode(antecedents(text)).alias("cluster"))


# ---- records of stories and sentences

def _parse(spark, sf):
    """Every word as a parse token that hangs on the one before it in its sentence."""
    own = _zones(spark, sf)
    dep = F.concat(F.lit("d"), (F.col("zone") % 5).cast("string"))
    tag = F.when(F.col("zone") % 3 == 0, "NN").otherwise("VB")
    return own.select("item", "sentence_index", (F.col("sentence_position") - 1).alias("pos"), F.col("sentence_position").alias("id"), F.col("word").alias("form"), tag.alias("tag"), (F.col("sentence_position") - 1).alias("head"), dep.alias("dep"), "zone")


@_sql(
    "story_records",
    """, s AS (SELECT item, zone, zone - 1 AS g, sentence_id, min(zone) OVER (PARTITION BY item, sentence_id) AS f FROM sn),
       h AS (SELECT item, count(*)::INT AS n_parse, count(DISTINCT sentence_id)::INT AS n_sentences, sum(CASE WHEN zone = f THEN -1 ELSE g - 1 END)::BIGINT AS heads FROM s GROUP BY item),
       x AS (SELECT item, count(*)::INT AS n_tokens, md5(string_agg(word, ' ' ORDER BY zone)) AS text_md5, max(char_end)::INT AS text_end, count(mean_rt) AS n_timed FROM off LEFT JOIN stats USING (item, zone) GROUP BY item)
       SELECT 'naturalstories_' || item AS doc_id, n_tokens, text_md5, text_end, n_timed, n_parse, n_sentences, heads FROM x JOIN h USING (item)""",
    "sn", "off", "stats",
)
def story_records(spark, sf):
    """Words, reading times and a parse joined into one record per story."""
    from .pipelines import build_stories

    return _record_facts(build_stories(P.tokens(spark, sf), P.rt_stats(spark, sf), _parse(spark, sf)))


def _record_facts(out):
    timed = F.size(F.filter("tokens", lambda t: t["mean_rt"].isNotNull())).cast("long")
    heads = F.aggregate("ud_tokens", F.lit(0).cast("long"), lambda a, t: a + t["head_g"])
    end = F.array_max(F.transform("ud_tokens", lambda t: t["char_end"]))
    return out.select("doc_id", "n_tokens", F.md5("text").alias("text_md5"), end.alias("text_end"), timed.alias("n_timed"), F.size("ud_tokens").alias("n_parse"), F.size("ud_sentences").alias("n_sentences"), heads.alias("heads"))


def _placed(spark, sf):
    """Words as parse tokens (odd ones hang on the next, even ones on the one before), and sentences with their places."""
    head = F.when(F.col("zone") % 2 == 1, F.col("zone")).otherwise(F.col("zone") - 2)
    toks = align.token_offsets(_zones(spark, sf)).select(F.col("item").alias("doc"), "sentence_index", "zone", (F.col("zone") - 1).alias("g"), head.alias("head_g"), F.concat(F.lit("d"), (F.col("zone") % 5).cast("string")).alias("dep"), "char_start", "char_end", "word")
    return toks, _sentence_texts(toks)


@_sql(
    "target_tokens",
    """, s AS (SELECT item, zone, sentence_id - 1 AS sentence_index, min(zone) OVER w AS f, max(zone) OVER w AS l, min(char_start) OVER w AS cs, char_start, char_end, CASE WHEN zone % 2 = 1 THEN zone + 1 ELSE zone - 1 END AS h
         FROM sn JOIN off USING (item, zone) WINDOW w AS (PARTITION BY item, sentence_id))
       SELECT item AS doc, sentence_index, zone, (zone - f)::INT AS i, CASE WHEN h BETWEEN f AND l THEN h - f ELSE -1 END::INT AS head, (char_start - cs)::INT AS char_start, (char_end - cs)::INT AS char_end FROM s""",
    "sn", "off",
)
def target_tokens(spark, sf):
    toks, sents = _placed(spark, sf)
    return discourse.target_tokens(toks, sents).select("doc", "sentence_index", "zone", "i", "head", "char_start", "char_end")


@_sql(
    "target_entities",
    """, s AS (SELECT item AS doc, sentence_id - 1 AS sentence_index, min(char_start) AS a, max(char_end) AS b FROM sn JOIN off USING (item, zone) GROUP BY ALL),
       t AS (SELECT item AS doc, string_agg(word, ' ' ORDER BY zone) AS text FROM tok GROUP BY item),
       o AS (SELECT s.doc, s.cs, s.ce, zone - 1 AS g, CASE WHEN zone % 2 = 1 THEN zone ELSE zone - 2 END AS head_g, 'd' || (zone % 5) AS dep FROM spans s JOIN off ON item = s.doc AND char_start < s.ce AND char_end > s.cs WHERE s.span % 2 = 1),
       r AS (SELECT doc, cs, ce, arg_min(dep, g + CASE WHEN EXISTS (SELECT 1 FROM o b WHERE b.doc = o.doc AND b.cs = o.cs AND b.ce = o.ce AND b.g = o.head_g) THEN 10000000 ELSE 0 END) AS grammatical_role FROM o GROUP BY doc, cs, ce)
       SELECT x.doc, sentence_index, span, (x.cs - a)::INT AS char_start, (x.ce - a)::INT AS char_end, substr(text, x.cs + 1, x.ce::BIGINT - x.cs) AS entity_text, grammatical_role
       FROM spans x JOIN s ON s.doc = x.doc AND x.cs >= a AND x.ce <= b JOIN t ON t.doc = x.doc LEFT JOIN r ON r.doc = x.doc AND r.cs = x.cs AND r.ce = x.ce WHERE span % 2 = 1 AND x.ce > x.cs""",
    "spans", "sn",
)
def target_entities(spark, sf):
    toks, sents = _placed(spark, sf)
    found = P.spans(spark, sf).where("span % 2 = 1 AND char_end > char_start").select("doc", "span", "char_start", "char_end")
    return discourse.target_entities(found, sents, toks).select("doc", "sentence_index", "span", "char_start", "char_end", "entity_text", "grammatical_role")


@_sql(
    "uncovered_count",
    """, u AS (SELECT item, count(*) AS n FROM off o WHERE zone % 3 = 0 AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc = o.item AND s.span % 5 = 0 AND char_start < ce AND char_end > cs) GROUP BY item)
       SELECT item AS doc, coalesce(any_value(n), 0) AS n_uncovered FROM tok LEFT JOIN u USING (item) GROUP BY item""",
    "spans",
)
def uncovered_count(spark, sf):
    toks = P.offsets(spark, sf).select(F.col("item").alias("doc"), F.when(F.col("zone") % 3 == 0, "NN").otherwise("VB").alias("tag"), "char_start", "char_end")
    return audit.uncovered_counts(toks, P.spans(spark, sf).where("span % 5 = 0"))


@_sql("html_escape", """SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS html_md5 FROM conversations""")
def html_escape(spark, sf):
    return P.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.html_escape(F.col("text"))).alias("html_md5"))


@_sql(
    "lm_stimuli",
    """, x AS (SELECT item, zone - 1 AS i, word, 1 + length(word) // 6 AS n FROM tok),
       j AS (SELECT a.item, a.i, b.i AS c, b.word, b.n, sum(b.n) OVER (PARTITION BY a.item, a.i ORDER BY b.i DESC) AS held FROM x a JOIN x b ON a.item = b.item AND b.i < a.i AND b.i > a.i - 12 AND (a.i - 1 - b.i) % 2 = 0)
       SELECT x.item, x.i, md5(coalesce(string_agg(j.word, ' ' ORDER BY j.c) || ' ', '') || any_value(x.word)) AS stimulus_md5 FROM x LEFT JOIN j ON j.item = x.item AND j.i = x.i AND j.held - j.n < 12 GROUP BY x.item, x.i""",
    "tok",
)
def lm_stimuli(spark, sf):
    """What a language model scores for each word: every second word before it until 12 subwords are held, then the word."""
    from .pipelines import stimuli_of

    own = P.tokens(spark, sf).select("item", (F.col("zone") - 1).alias("i"), "word", (1 + F.floor(F.length("word") / 6)).cast("int").alias("pieces"))
    return stimuli_of(own, 12, 2).select("item", "i", F.md5("stimulus").alias("stimulus_md5"))


# ---- more statistics

@_sql("fill_missing", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END AS user_id, CASE WHEN event_id % 5 <> 0 THEN 'x' END AS mark FROM events")
def fill_missing(spark, sf):
    gap = lambda c, k: F.when(F.col("event_id") % k != 0, F.col(c) if c != "mark" else F.lit("x")).alias(c)
    return stats.fill_missing(P.table(spark, sf, "events").select("event_id", gap("value", 3), gap("user_id", 4), gap("mark", 5)))


@_sql("log_freq_summary", "SELECT round(min(ln(length(word) + 1)), 6) AS least, round(max(ln(length(word) + 1)), 6) AS greatest, 0.0::DOUBLE AS mean_z FROM tok WHERE zone % 3 = 0", "tok")
def log_freq_summary(spark, sf):
    freq = F.when(F.col("zone") % 3 == 0, F.length("word"))
    out = stats.log_frequency_summary(P.tokens(spark, sf, dealt=False).select(freq.alias("freq")))
    return out.select(F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"), F.abs(F.round("mean_z", 6)).alias("mean_z"))


@_sql("training_rows", "SELECT item, zone, word, length(word) AS word_length FROM tok WHERE item IN (1, 3, 5, 7, 9) AND zone % 4 <> 0", "tok")
def training_rows(spark, sf):
    """Rows that models are fitted on, with the length of their words."""
    toks = P.tokens(spark, sf)
    freqs = toks.where("zone % 4 <> 0").select("item", "zone", F.length("word").alias("freq"))
    surp = surprisal.sentence_numbers(toks).select("item", "zone", "sentence_id")
    own = stats.analysis_table(toks, surp, freqs, spark.createDataFrame([], "item long, sentence_id int, iv double"))
    return stats.training_rows(own).select("item", "zone", "word", F.col("word_length").cast("long").alias("word_length"))


@_sql(
    "f_test",
    """, m AS (SELECT count(*)::DOUBLE AS n, regr_syy(ln(l_extendedprice), l_quantity) AS syy, regr_sxx(ln(l_extendedprice), l_quantity) AS sxx, regr_sxy(ln(l_extendedprice), l_quantity) AS sxy FROM lineitem)
       SELECT round(((sxy * sxy / sxx) / ((syy - sxy * sxy / sxx) / (n - 2))) / 1000, 3) AS f_thousands, 1 AS df1, n - 2 AS df2 FROM m""",
)
def f_test(spark, sf):
    """Analysis of variance of the model with a mean only and that with a slope."""
    own, y = P.table(spark, sf, "lineitem"), F.log("l_extendedprice")
    test = stats.f_test(stats.linear_fit(own, y, {}), stats.linear_fit(own, y, {"quantity": F.col("l_quantity")}))
    return spark.createDataFrame([(round(float(test["f"]) / 1000, 3), int(test["df1"]), float(test["df2"]))], "f_thousands double, df1 int, df2 double")


ORACLE_SQL["f_test"] = "WITH " + ORACLE_SQL["f_test"].removeprefix(", ")


@_sql("shape", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(skewness(value), 5) AS skewness, round(kurtosis(value) + 3, 5) AS kurtosis FROM events")
def shape(spark, sf):
    r = stats.describe_shape(P.table(spark, sf, "events"), "value")
    return spark.createDataFrame([(int(r["n"]), round(r["mean"], 6), round(r["sd"], 6), round(r["skewness"], 5), round(r["kurtosis"], 5))], "n long, mean double, sd double, skewness double, kurtosis double")


@_sql("shapiro_sample", None)
def shapiro_sample(spark, sf):
    """W of the first 5000 values of a table in a stated order; tests hold it against published values."""
    x = stats.first_values(P.table(spark, sf, "events"), "value", ["event_id"])
    test = stats.shapiro_wilk(x)
    return spark.createDataFrame([(len(x), test["w"], test["p"])], "n int, w double, p double")


@_sql("iv_combined_transport", None)
def iv_combined_transport(spark, sf):
    """All three terms; the solver of the third is beyond SQL."""
    terms = {"feature": (iv_feature_l1(spark, sf), 0.4), "graph": (iv_graph(spark, sf), 0.3), "transport": (ot_distance(spark, sf), 0.3)}
    return distance.combined(terms, KEYS).withColumn("distance", F.round("distance", 9))


# ---- files, written and read back

def _table_file(df, name: str, header: bool = True) -> str:
    """The path of a tab-separated copy of `df` in the shared folder; it is deleted when the driver ends."""
    path = _own_path(df.sparkSession, name)
    plain = {"sep": "\t", "header": header, "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**plain).option("compression", "gzip").csv(path)
    return path


def _own_path(spark, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


@_sql("tokens_file", "SELECT item::INT AS item, zone, word FROM tok WHERE word <> ''", "tok")
def tokens_file(spark, sf):
    path = _table_file(P.tokens(spark, sf, dealt=False).where("word <> ''").select("word", "zone", "item"), "tok")
    return readers.read_tokens(spark, path).drop("pos")


@_sql("rt_stats_file", "SELECT item::INT AS item, zone, round(mean_rt, 6) AS mean_rt, round(gmean_rt, 6) AS gmean_rt, n_subj::INT AS n_subj FROM stats", "stats")
def rt_stats_file(spark, sf):
    names = {"mean_rt": "meanItemRT", "gmean_rt": "gmeanItemRT", "n_subj": "nItem"}
    own = P.rt_stats(spark, sf).withColumnsRenamed(names).withColumn("sdItemRT", F.lit(1.0))
    out = readers.read_rt_stats(spark, _table_file(own, "rt"))
    return out.select("item", "zone", F.round("mean_rt", 6).alias("mean_rt"), F.round("gmean_rt", 6).alias("gmean_rt"), "n_subj")


@_sql("subject_rts_file", "SELECT item::INT AS item, zone, worker::VARCHAR AS worker, count(*) AS n FROM (SELECT DISTINCT item, zone, worker FROM rt WHERE event_id % 11 <> 0) GROUP BY ALL", "rt")
def subject_rts_file(spark, sf):
    """Reading times per reader; rows whose time is no number are left out, of repeated ones one is kept."""
    own = P.events_rt(spark, sf).select(F.col("worker").alias("WorkerId"), "item", "zone", F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("rt").cast("string")).alias("RT"))
    return readers.read_subject_rts(spark, _table_file(own, "subjects")).groupBy("item", "zone", "worker").agg(F.count("*").alias("n"))


@_sql("freqs_file", "SELECT item::INT AS item, zone, length(word)::DOUBLE AS freq FROM tok WHERE zone % 2 = 0", "tok")
def freqs_file(spark, sf):
    part = F.when(F.col("zone") % 2 == 0, "word").otherwise("char")
    index = F.concat_ws(".", F.col("item").cast("string"), F.col("zone").cast("string"), part)
    own = P.tokens(spark, sf, dealt=False).select(index.alias("index"), F.lit("1").alias("order"), F.lit("w").alias("word"), F.length("word").alias("freq"), F.lit("").alias("empty"))
    return readers.read_freqs(spark, _table_file(own, "freqs", header=False))


@_sql("surprisal_file", "SELECT item::INT AS item, zone, sentence_id, round(length(word) / 8.0, 6) AS surprisal, md5(word) AS word_md5 FROM sn WHERE word <> ''", "sn")
def surprisal_file(spark, sf):
    path = _own_path(spark, "surprisal")
    sinks.write_surprisal(surprisal.sentence_numbers(P.tokens(spark, sf)).where("word <> ''").withColumn("surprisal", F.length("word") / F.lit(8.0)), path, compression="gzip")
    return readers.read_surprisal(spark, path).select("item", "zone", "sentence_id", F.round("surprisal", 6).alias("surprisal"), F.md5("word").alias("word_md5"))


@_sql("jsonl_file", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def jsonl_file(spark, sf):
    path, own = _own_path(spark, "jsonl"), P.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    sinks.write_jsonl(own, path)
    out = readers.read_jsonl(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema))
    return out.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@_sql("conllx_file", "SELECT item::INT AS item, zone, row_number() OVER (PARTITION BY item, sentence_id ORDER BY zone)::INT AS id, md5(word) AS form_md5, (row_number() OVER (PARTITION BY item, sentence_id ORDER BY zone) - 1)::INT AS head, 'd' || (zone % 5) AS dep FROM sn", "sn")
def conllx_file(spark, sf):
    return readers.read_conllx(spark, _conllx_file(spark, sf)).select("item", "zone", "id", F.md5("form").alias("form_md5"), "head", "dep")


@_sql("conllx_source", ORACLE_SQL["conllx_file"])
def conllx_source(spark, sf):
    """The same files by the data source; they are compressed, so each is a range."""
    return load_conllx(spark, _conllx_file(spark, sf), 4 << 20).select("item", "zone", "id", F.md5("form").alias("form_md5"), "head", "dep")


def _conllx_file(spark, sf):
    """A parse as sentences of ten columns, behind comments and between blank lines; a compressed file for each task that has documents."""
    own, blank = _parse(spark, sf), F.lit("_")
    misc = F.concat(F.lit("TokenId="), F.col("item").cast("string"), F.lit("."), F.col("zone").cast("string"))
    line = F.concat_ws("\t", F.col("id").cast("string"), "form", blank, blank, "tag", blank, F.col("head").cast("string"), "dep", blank, misc)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    path = _own_path(spark, "conllx")
    own.groupBy("item", "sentence_index").agg(F.concat(F.lit("# a comment\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("value")).select("value").write.option("compression", "gzip").text(path)
    return path


@_sql("story_stream", ORACLE_SQL["story_records"])
def story_stream(spark, sf):
    """The records of `story_records` from a stream of their sentences, dealt to files at random, every third one twice."""
    from .. import schemas
    from ..streaming.stories import story_parts, stream_stories

    folder = _own_path(spark, "stories")
    parts = story_parts(P.tokens(spark, sf), P.rt_stats(spark, sf), _parse(spark, sf))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.pmod("part", F.lit(3)) == 0, 2).otherwise(1)))
    files = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts.withColumn("__copy", twice).repartition(files, F.hash("item", "part", "__copy")).drop("__copy").write.json(f"{folder}/in")
    query = stream_stories(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", files_per_batch=-(-files // 3))
    query.awaitTermination()
    return _record_facts(readers.read_jsonl(spark, f"{folder}/out/stories", schemas.STORY))


for _name in ("story_records", "story_stream", "target_tokens", "target_entities", "uncovered_count", "lm_stimuli"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(" , ", ", ", 1)


for _name in ORACLE_SQL:
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("  , ", ", ")

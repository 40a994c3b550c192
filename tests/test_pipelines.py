"""Files in, records out: readers, the story and item pipelines, the stream, the audit page."""

import json
import math
import re

from pyspark.sql import functions as F

from spanwright import annotators
from spanwright import schemas as S
from spanwright.annotators.rules import Precomputed, RuleAnnotator
from spanwright.annotators.scorers import CountScorer
from spanwright.plans import pipelines
from spanwright.sources import annotation, readers, sinks
from spanwright.streaming.items import annotate_stream

WORDS = "Mary saw John. She waved.".split()
PARSE = [("Mary", "NNP", 2, "nsubj", 1), ("saw", "VBD", 0, "root", 2), ("John", "NNP", 2, "dobj", 3), (".", ".", 2, "punct", 3)], [("She", "PRP", 2, "nsubj", 4), ("waved", "VBD", 0, "root", 5), (".", ".", 2, "punct", 5)]


def write_corpus(folder):
    (folder / "tok.tsv").write_text("word\tzone\titem\n" + "".join(f"{w}\t{i}\t1\n" for i, w in enumerate(WORDS, 1)))
    (folder / "rt.tsv").write_text("item\tzone\tmeanItemRT\tgmeanItemRT\tsdItemRT\tnItem\n1\t1\t100\t90\t5\t3\n1\t1\t110\t95\t5\t3\n1\t2\t200\tx\t\t3\n")
    (folder / "subj.tsv").write_text("WorkerId\titem\tzone\tRT\tword\nw1\t1\t1\t300.5\tMary\nw1\t1\t2\tbad\tsaw\nw2\t1\t4\t250\tShe\n")
    lines = [["\t".join([str(i), f, "_", "_", t, "_", str(h), d, "_", f"TokenId=1.{z}"]) for i, (f, t, h, d, z) in enumerate(s, 1)] for s in PARSE]
    (folder / "ud.conllx").write_text("\n\n".join("\n".join(["# a comment", *s]) for s in lines) + "\n")
    return [str(folder / n) for n in ("tok.tsv", "rt.tsv", "subj.tsv", "ud.conllx")]


def fixed():
    text = " ".join(WORDS)
    return lambda: Precomputed({text: ([], [{"label": "PER", "char_start": 0, "char_end": 4}], [[(0, 4), (15, 18)], [(9, 13)]])})


def test_stories_and_sentences(spark, tmp_path):
    tok, rt, subj, ud = write_corpus(tmp_path)
    stories = pipelines.build_stories(readers.read_tokens(spark, tok), readers.read_rt_stats(spark, rt), readers.read_conllx(spark, ud))
    story = stories.first()
    assert story["text"] == " ".join(WORDS) and story["n_tokens"] == 5 and story["doc_id"] == "naturalstories_1"
    assert [(t["form"], t["char_start"], t["char_end"], t["head_g"]) for t in story["ud_tokens"]][2:5] == [("John", 9, 13, 1), (".", 13, 14, 1), ("She", 15, 18, 5)]
    assert story["tokens"][0]["mean_rt"] == 110 and story["tokens"][1]["gmean_rt"] is None
    done = pipelines.annotate_stories(stories, fixed(), context_window=1, subject_rts=readers.read_subject_rts(spark, subj))
    sinks.write_jsonl(done, str(tmp_path / "records"))
    records = readers.read_jsonl(spark, str(tmp_path / "records"), S.SENTENCE_RECORD)
    out = records.orderBy("sentence_index").collect()
    first, second = out
    assert (first["target"], first["context"], second["context"]) == ("Mary saw John.", "", "Mary saw John.")
    assert first["reading_time_sum_mean"] == 310 and second["reading_time_sum_mean"] is None
    assert first["entity_grid"] == {"0": ["nsubj"], "1": ["dobj"]} and second["entity_grid"] == {"0": ["nsubj"]}
    assert (second["given_entities"], second["new_entities"], first["new_entities"]) == ([0], [], [0, 1])
    assert second["target_mentions"][0]["text"] == "She" and first["target_mentions"][0]["ner_label"] == "PER"
    assert first["reading_times_by_subject"]["w1"]["rt_sum"] == 300.5 and list(second["reading_times_by_subject"]) == ["w2"]
    audit = pipelines.audit_stories(records)
    assert sinks.write_page(audit, str(tmp_path / "page.html")) == 1
    page = (tmp_path / "page.html").read_text()
    assert "1 entities with several mentions, 1 with one, 0 nouns and pronouns outside all mentions" in page
    assert 'class="lone"' in page and "--hue:0.0" in page and "None" not in page
    target = first["segments"]["target"]
    assert [(t["form"], t["i"], t["head"], t["char_start"], t["char_end"], t["zone"]) for t in target["tokens"]][1:3] == [("saw", 1, -1, 5, 8, 2), ("John", 2, 1, 9, 13, 3)]
    assert [tuple(e) for e in target["entities"]] == [("Mary", "PER", 0, 4, "nsubj")] and first["segments"]["context"]["text"] == ""
    assert [(t["form"], t["head"], t["char_start"]) for t in second["segments"]["target"]["tokens"]] == [("She", 1, 0), ("waved", -1, 4), (".", 1, 9)]
    assert first["dataset"] == "naturalstories" and first["error"] is None
    sinks.write_jsonl(stories, str(tmp_path / "stories"))
    line = json.loads(next(p for p in (tmp_path / "stories").glob("part-*") if p.stat().st_size).read_text().splitlines()[0])
    assert line["tokens"][2]["mean_rt"] is None and "mean_rt" in line["tokens"][2]


def test_windows_of_a_story_are_stitched(spark, tmp_path):
    tok, rt, _, ud = write_corpus(tmp_path)
    stories = pipelines.build_stories(readers.read_tokens(spark, tok), readers.read_rt_stats(spark, rt), readers.read_conllx(spark, ud))
    whole = pipelines.annotate_stories(stories, RuleAnnotator).orderBy("sentence_index").collect()
    cut = pipelines.annotate_stories(stories, RuleAnnotator, max_words=100).orderBy("sentence_index").collect()
    assert [r["entity_grid"] for r in whole] == [r["entity_grid"] for r in cut]


def test_several_windows_of_a_story(spark):
    """Mary is in all sentences, so windows that share one join up; Zed is only in the first window, Yan in the last."""
    texts = ["Then Mary saw Zed.", "Later Mary slept here.", "Then she met Mary now.", "So Mary saw Yan."]
    words = [(1, i, w) for i, w in enumerate(" ".join(texts).split(), 1)]
    tokens = spark.createDataFrame(words, "item int, zone int, word string")
    stats = spark.createDataFrame([(1, 1, 1.0, 1.0)], "item int, zone int, mean_rt double, gmean_rt double")
    zone, parse = 0, []
    for s, t in enumerate(texts):
        for k, w in enumerate(t.split()):
            zone += 1
            parse.append((1, s, k, k + 1, w, "NN", 0 if k == 0 else 1, "root" if k == 0 else "dep", zone))
    parse = spark.createDataFrame(parse, "item int, sentence_index int, pos int, id int, form string, tag string, head int, dep string, zone int")
    stories = pipelines.build_stories(tokens, stats, parse)

    class Names(RuleAnnotator):
        def clusters(self, text):
            found = {n: [(m.start(), m.end()) for m in re.finditer(n, text)] for n in ("Mary", "Zed", "Yan")}
            return [c for c in found.values() if c]

    rows = pipelines.annotate_stories(stories, Names, max_words=9, overlap=1).orderBy("sentence_index").collect()
    found = [[(m["text"], m["cluster_id"]) for m in r["target_mentions"]] for r in rows]
    assert [[t for t, _ in f] for f in found] == [["Mary", "Zed"], ["Mary"], ["Mary"], ["Mary", "Yan"]]
    ids = {t: {c for f in found for x, c in f if x == t} for t in ("Mary", "Zed", "Yan")}
    assert all(len(x) == 1 for x in ids.values()) and len(set.union(*ids.values())) == 3

    class Broken(Names):
        def parse(self, text):
            raise RuntimeError("no parser")

    failed = pipelines.annotate_stories(stories, Broken).collect()
    assert len(failed) == 4 and {r["error"] for r in failed} == {"no parser"} and failed[0]["segments"]["target"]["entities"] == []


def test_items(spark):
    items = spark.createDataFrame([("A1", "Mary slept.", "She woke.", None, ["Then Mary ran.", "It rained."]), ("A2", None, "Mary left\nMary.", "Bye", [])], "id string, context string, target string, post_context string, alternatives array<string>")
    done = {r["id"]: r for r in pipelines.annotate_items(items, RuleAnnotator, turn_sep="\n").collect()}
    cluster = done["A1"]["coref_clusters"][0]["mentions"]
    assert [(x["segment"], x["text"], x["char_start"]) for x in cluster] == [("context", "Mary", 0), ("target", "She", 0)]
    assert done["A1"]["entity_grid"] == {"0": ["root"]} and set(done["A2"]["segments"]) == {"context", "target", "post_context"}
    assert done["A2"]["segments"]["target"]["text"] == "Mary left Mary."

    class Broken(RuleAnnotator):
        def clusters(self, text):
            raise RuntimeError("no model")

    failed = pipelines.annotate_items(items, Broken).first()
    assert failed["error"] == "no model" and failed["coref_clusters"] == []
    rows = {r["id"]: r for r in pipelines.annotate_alternatives(items, RuleAnnotator, "id").collect()}
    done = rows["A1"]["alternatives_annotated"]
    assert [x["text"] for x in done] == ["Then Mary ran.", "It rained."] and done[0]["segments"]["target"]["text"] == "Then Mary ran."
    assert done[0]["coref_clusters"][0]["mentions"][0]["text"] == "Mary" and done[0]["error"] is None


def test_stream_gives_the_batch_result(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"context": "Mary slept.", "target": "She woke."}) + "\n")
    query = annotate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), RuleAnnotator)
    query.awaitTermination(120)
    rows = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert len(rows) == 1 and rows[0]["entity_grid"] == {"0": ["root"]} and rows[0]["post_context"] is None


def test_scores(spark):
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate(WORDS, 1)], "item int, zone int, word string")

    class Letters:
        """A piece for each letter; the last piece of a stimulus tells how many there are."""

        def pieces(self, words):
            return [len(w) for w in words]

        def scores(self, texts):
            return [[("Ġ" + t.split()[0], -100.0), ("Ġx", -float(len(t.split()))), ("y", -0.5)] for t in texts]

    out = pipelines.score_stories(tokens, Letters, size=6).orderBy("zone").collect()
    # Contexts: none; Mary; saw Mary; John. saw (8 letters); She John.
    assert [r["surprisal"] for r in out] == [1.5, 2.5, 3.5, 3.5, 3.5] and [r["sentence_id"] for r in out] == [1, 1, 1, 2, 2]
    by_words = pipelines.score_stories(tokens, lambda: CountScorer({"saw": 3.0}), size=3, stride=2).orderBy("zone").collect()
    assert [round(r["surprisal"], 6) for r in by_words] == [round(-math.log2(x / 5), 6) for x in (1, 4, 1, 1, 1)]
    texts = [r["stimulus"] for r in pipelines.stimuli_of(tokens.selectExpr("item", "zone - 1 AS i", "word", "1 AS pieces"), 4, 2).orderBy("i").collect()]
    assert texts == ["Mary", "Mary saw", "saw John.", "Mary John. She", "saw She waved."]


def test_manual_annotation(spark, tmp_path):
    rows = ["story_id;sent_id;token_id;deprel;form;cluster;mention;comment", '6;0;1;nsubj;Al;1;;""', "6;0;1.10;root;x;;;", "6;1;2;nsubj;he;;1;", "6;1;3;obj;both;;1+3;", "6;2;4;obj;Bo;3;;", "6;2;5;obj;z;1;;"]
    (tmp_path / "a.csv").write_bytes("\r\n".join(rows).encode())
    read = annotation.read_annotation(spark, str(tmp_path / "a.csv"))
    assert [r["token_id"] for r in read.orderBy("pos").collect()][1] == "1.10"
    mentions = annotation.annotated_mentions(read)
    assert mentions.count() == 6
    found = {(r["cluster"], r["problem"]) for r in annotation.problems(mentions).collect()}
    assert found == {(1, "introduced more than once"), (3, "mentioned before its introduction")}


def test_templates(spark, tmp_path):
    _, _, _, ud = write_corpus(tmp_path)
    template = annotation.annotation_template(readers.read_conllx(spark, ud))
    annotation.write_templates(template, str(tmp_path / "out"))
    lines = next((tmp_path / "out" / "story=1").glob("*.csv")).read_text().splitlines()
    assert lines[0] == ";".join(annotation.TEMPLATE) and lines[3].startswith("1;0;3.1;dobj;John;") and len(lines) == 8


def test_factory():
    assert annotators.build("none").clusters("Mary Mary") == []
    try:
        annotators.build("unknown")
    except ValueError as e:
        assert "rules" in str(e)


def test_reader_of_scores(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"story_{n}.csv").write_text(f"sentence_index,iv_a,other\n0,{n}.5,x\n")
    got = sorted(tuple(r) for r in readers.read_iv_scores(spark, str(tmp_path), ["iv_a"]).collect())
    assert got == [(2, 0, 2.5), (10, 0, 10.5)]
    by_place = sorted(tuple(r) for r in readers.read_iv_scores(spark, str(tmp_path), ["iv_a"], by_name=False).collect())
    assert by_place == [(1, 0, 10.5), (2, 0, 2.5)]
    (tmp_path / "f.tsv").write_text("1.2.word\t1\tcat\t5\t\n1.2.word.x\t1\tcat\t5\t\n1.3.char\t1\tc\t9\t\n")
    assert {(r["item"], r["zone"], r["freq"]) for r in readers.read_freqs(spark, str(tmp_path / "f.tsv")).collect()} == {(1, 2, 5.0)}

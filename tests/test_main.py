"""The six commands on small files, and the optional annotators on stand-ins for their libraries."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F
from test_pipelines import write_corpus

from spanwright import annotators
from spanwright.__main__ import main


def lines_of(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_from_corpus_to_page(spark, tmp_path, capsys):
    tok, rt, subj, ud = write_corpus(tmp_path)
    at = lambda name: str(tmp_path / name)
    main(["stories", "--tok", tok, "--wordinfo", rt, "--ud-conll", ud, "--out", at("stories")])
    assert lines_of(tmp_path / "stories")[0]["n_tokens"] == 5
    main(["sentences", "--in", at("stories"), "--out", at("records"), "--context-window", "1", "--per-subject-rts", subj])
    records = sorted(lines_of(tmp_path / "records"), key=lambda r: r["sentence_index"])
    assert [r["target"] for r in records] == ["Mary saw John.", "She waved."] and records[0]["reading_times_by_subject"]["w1"]["rt_sum"] == 300.5
    main(["audit", "--in", at("records"), "--out", at("page.html")])
    assert "<html" in (tmp_path / "page.html").read_text() and "1 stories" in capsys.readouterr().out
    main(["audit", "--in", at("records"), "--out", at("pages"), "--page-per-story"])
    main(["templates", "--ud-conll", ud, "--out", at("templates")])
    assert (tmp_path / "templates").exists() and (tmp_path / "pages").exists()


def test_surprisal_keeps_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "tok.tsv").write_text("word\tzone\titem\nA\t1\t1\ncat.\t2\t1\nsat\t2\t1\nthere.\t3\t1\n")
    (tmp_path / "counts.tsv").write_text("A\t2\ncat.\t1\nsat\t1\n")
    main(["surprisal", "--tok", str(tmp_path / "tok.tsv"), "--model-name-or-path", f"counts:{tmp_path / 'counts.tsv'}", "--window-size", "4", "--stride", "2", "--out-file", str(tmp_path / "out")])
    found = tmp_path / "out"
    text = found.read_text() if found.is_file() else "".join(p.read_text() for p in sorted(found.glob("part-*")))
    rows = [x.split("\t") for x in text.splitlines()]
    head, rows = rows[0], rows[1:]
    got = sorted((int(r[head.index("sentence_id")]), int(r[head.index("sentence_position")]), r[head.index("word")]) for r in rows)
    assert got == [(1, 1, "A"), (1, 2, "cat."), (2, 1, "sat"), (2, 2, "there.")]


def test_repeated_zones_are_numbered_by_their_place(spark):
    from spanwright.operators import surprisal

    words = ["a.", "b", "c.", "d", "e.", "f"]
    frame = spark.createDataFrame([(1, 1, w, i) for i, w in enumerate(words)], "item int, zone int, word string, pos int").repartition(3)
    got = surprisal.sentence_numbers(frame, order=["zone", "pos"]).orderBy("pos")
    assert [(r["sentence_id"], r["sentence_position"]) for r in got.collect()] == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1)]


def test_items_keep_their_own_alternatives(spark, tmp_path):
    items = [["Bob left."], ["Cid ran.", "Dora sat."], [], ["Bob left."], None]
    (tmp_path / "items.jsonl").write_text("".join(json.dumps({"context": "Ann came.", "target": "She sat.", "alternatives": a}) + "\n" for a in items))
    main(["items", "--in", str(tmp_path / "items.jsonl"), "--out", str(tmp_path / "out"), "--annotate-alternatives"])
    got = lines_of(tmp_path / "out")
    told = sorted((r["alternatives"] or [], [x["text"] for x in r.get("alternatives_annotated") or []]) for r in got)
    assert told == sorted((a or [], a or []) for a in items)
    main(["items", "--in", str(tmp_path / "items.jsonl"), "--out", str(tmp_path / "plain")])
    assert len(lines_of(tmp_path / "plain")) == 5


def test_missing_paths_end_the_command(spark):
    with pytest.raises(SystemExit):
        main(["stories", "--tok", "x", "--out", "y"])


class _Token(types.SimpleNamespace):
    def __len__(self):
        return len(self.text)


def _spacy(monkeypatch):
    """A stand-in that splits at blanks."""

    class Doc(list):
        ents = ()
        noun_chunks = ()

        @property
        def sents(self):
            return [list(self)]

    def nlp(text):
        out, at = Doc(), 0
        for i, w in enumerate(text.split(" ")):
            out.append(_Token(i=i, text=w, idx=at, lemma_=w, pos_="X", tag_="X", dep_="dep", head=types.SimpleNamespace(i=i), ent_type_="", ent_iob_="O", whitespace_=" "))
            at += len(w) + 1
        return out

    module = types.ModuleType("spacy")
    module.load = lambda name, **_: nlp
    module.util = types.SimpleNamespace(is_package=lambda name: True)
    monkeypatch.setitem(sys.modules, "spacy", module)


def test_maverick_loads_checkpoints_with_objects(monkeypatch):
    from spanwright.annotators import models  # noqa: F401  registers it

    _spacy(monkeypatch)
    seen = []
    torch, library = types.ModuleType("torch"), types.ModuleType("maverick")
    torch.load = strict = lambda *a, **k: seen.append(k.get("weights_only"))

    class Model:
        def __init__(self, device, hf_name_or_path=None):
            torch.load("checkpoint", weights_only=None)
            self.model = types.SimpleNamespace(float=lambda: "in full precision")

        def predict(self, sentences, singletons=False):
            own = [[(0, 0), (2, 2)]] + ([[(1, 1)]] if singletons else [])
            return {"clusters_token_offsets": own}

    library.Maverick = Model
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "maverick", library)
    plain = annotators.build("maverick")
    assert seen == [False] and torch.load is strict and plain.model.model == "in full precision"
    assert plain.clusters("Ann saw her") == [[(0, 3), (8, 11)]]
    assert annotators.build("maverick", model="x-litbank").clusters("Ann saw her") == [[(0, 3), (8, 11)], [(4, 7)]]


def test_mentions_of_very_long_sentences_keep_their_order(spark):
    from spanwright.operators import audit

    rows = [(1, 1, 0, "late head"), (1, 0, 250_000, "first head")]
    frame = spark.createDataFrame(rows, "c int, sentence_index int, pos int, text string").withColumn("at", F.struct("sentence_index", "pos"))
    assert audit.representative_heads(frame.withColumn("text", F.when(F.col("pos") == 0, "the dog").otherwise("the cat")), ["c"], order="at").first()["head"] == "cat"


def batched():
    """A class that workers get by value."""

    class Batched:
        """Clusters of several texts at once; a batch with the word "bad" fails, and so does that text."""

        batch_size = 3

        def __init__(self, log):
            self.log = log

        def parse(self, text):
            return [], []

        def clusters(self, text):
            if "bad" in text:
                raise ValueError("no")
            return [[(0, len(text.split()[0]))]]

        def clusters_many(self, texts):
            with open(self.log, "a") as f:
                f.write(json.dumps(texts) + "\n")
            return [self.clusters(t) for t in texts]

    return Batched


def test_models_see_batches_of_like_length(spark, tmp_path):
    import functools

    from spanwright.plans import pipelines

    words = [f"{'w' * (1 + i * 7 % 11)} x" for i in range(11)] + ["bad text of its own", "", "w x"]
    items = spark.createDataFrame([(i, None, w) for i, w in enumerate(words)], "id int, context string, target string").coalesce(1)
    out = pipelines.annotate_items(items, functools.partial(batched(), str(tmp_path / "log"))).collect()
    assert [r["id"] for r in out] == list(range(len(words)))
    for r, w in zip(out, words, strict=True):
        spans = [(m["char_start"], m["char_end"]) for c in r["coref_clusters"] for m in c["mentions"]]
        assert spans == ([] if not w or "bad" in w else [(0, len(w.split()[0]))]) and (r["error"] == "no") == ("bad" in w)
    seen = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert [len(b) for b in seen] == [3, 3, 3, 3] and [len(t) for b in seen for t in b] == sorted(len(t) for b in seen for t in b)


def test_fastcoref_takes_texts_together(monkeypatch):
    from spanwright.annotators import models  # noqa: F401  registers it

    _spacy(monkeypatch)
    library, calls = types.ModuleType("fastcoref"), []

    class FCoref:
        def __init__(self, device):
            pass

        def predict(self, texts):
            calls.append(list(texts))
            return [types.SimpleNamespace(get_clusters=lambda as_strings, t=t: [[(0, len(t))]]) for t in texts]

    library.FCoref = FCoref
    monkeypatch.setitem(sys.modules, "fastcoref", library)
    own = annotators.build("fastcoref")
    assert own.clusters_many(["ab", "c"]) == [[[(0, 2)]], [[(0, 1)]]] and own.clusters("abc") == [[(0, 3)]] and calls == [["ab", "c"], ["abc"]]


def test_coreferee_gives_spans_of_chains(monkeypatch):
    from spanwright.annotators import models  # noqa: F401  registers it

    _spacy(monkeypatch)
    load = sys.modules["spacy"].load

    def with_chains(name, **options):
        nlp = load(name)

        def run(text):
            doc = nlp(text)
            doc._ = types.SimpleNamespace(coref_chains=[[types.SimpleNamespace(token_indexes=[1, 0]), types.SimpleNamespace(token_indexes=[2])]])
            return doc

        run.add_pipe = lambda pipe: None
        return run

    monkeypatch.setattr(sys.modules["spacy"], "load", with_chains)
    assert annotators.build("coreferee").clusters("Ann Lee left") == [[(0, 7), (8, 12)]]

"""Token alignment against whole texts encoded by both tokenizers, without segments."""

import hashlib
from collections import defaultdict

import pytest

from spanwright.llm import token_align
from spanwright.llm.packing import byte_alphabet, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """Rows of `aligned` from whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_file, b_file = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a_file.encode_special_tokens = True
    names, byte_of = {i: t for t, i in a_file.get_vocab().items()}, {c: b for b, c in byte_alphabet().items()}

    def bytes_a(i):
        return names[i].encode() if i == 50256 else bytes(byte_of[c] for c in names[i])

    def bytes_b(i):
        piece = b_file.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_file.is_byte(i) else piece.replace("▁", " ").encode()

    per, holders = [], defaultdict(set)
    for at, (key, text) in enumerate(rows):
        links, groups, a, b = [], [], [], []
        if text:
            a, b, whole = a_file.encode(" " + text, add_special_tokens=False).ids, b_file.encode(text), (" " + text).encode()
            if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
                a, b = [], []
        ends_a, ends_b = {0: 0}, {0: 0}
        for ends, ids, of in ((ends_a, a, bytes_a), (ends_b, b, bytes_b)):
            place = 0
            for n, i in enumerate(ids, 1):
                place += len(of(i))
                ends[place] = n
        cuts = sorted(set(ends_a) & set(ends_b))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x, y = a[ends_a[lo] : ends_a[hi]], b[ends_b[lo] : ends_b[hi]]
            groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            links += [(i, j) for i in x for j in y]
        for link in set(links):
            holders[link].add(at)
        per.append((key, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count, best = {k: len(v) for k, v in holders.items()}, defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(k, na, nb, ng, len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), s) for k, na, nb, ng, ls, s in per]


ODD = [
    "", None, " ", "  ", "\n", "a", "a", "▁x", "a ▁ b", "<s> </s> <|endoftext|> <unk>", "x\r\ny;\r\nz", "foo \n\n bar", "\tfoo\t\tbar ", "é　x  y", "\x00 \x1c a\x85 b", "🎉🎉 日本語 テスト",
    "a" * 3000, "l'été 's 're don't", "� x", " \n ", "x ​ y", "foo\x1d bar", ") \r x(\r)", "the cat the cat",
]


def test_odd_texts_like_whole_texts(spark):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame([(k, t, -1, "x") for k, t in rows], "doc_id long, text string, chunk int, body string")
    assert sorted(map(tuple, token_align.aligned(docs, *PATHS).select(*COLUMNS).collect())) == sorted(plain(rows))


def test_query_like_whole_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_align.op11_token_align(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect())) == sorted(plain(rows))


def test_many_chunks_and_buckets_change_nothing(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate([*ODD, *ODD])]
    monkeypatch.setattr(token_align, "CHUNK_CHARS", 40)
    monkeypatch.setattr(token_align, "BUCKET_CHARS", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert sorted(map(tuple, token_align.aligned(docs, *PATHS).select(*COLUMNS).collect())) == sorted(plain(rows))


def test_empty_table_and_other_keys(spark):
    assert token_align.aligned(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
    got = token_align.aligned(spark.createDataFrame([("k", "one two"), (None, "one")], "name string, text string"), *PATHS, key="name").collect()
    assert {r["name"]: r["n_a"] for r in got} == {"k": 2, None: 1}


@pytest.mark.parametrize("text", ["a b\nc\td\re", "x;\r\n y", "  lead", "trail  "])
def test_segments_give_the_text_back(text):
    assert "".join(token_align.tokenizers(*PATHS).segments(text)) == " " + text


def test_border_keeps_what_a_piece_joins():
    border = token_align.border_pattern(PATHS[0], ["x\n", "▁x"])
    assert border.split(" x\nx y\nz") == [" x\nx", " y", "\nz"]


def test_no_cut_where_nothing_is_known(tmp_path):
    import json

    spec = json.loads(open(PATHS[0]).read())
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    assert token_align.border_pattern(str(tmp_path / "t.json"), []) is None

"""WARC files in all states: members, cuts, trailing bytes, codings; derivatives against a plain version; hostile pages."""

import gzip
import json
import random
import time
import zlib

import pytest

from spanwright.llm import warc


def response(body, *http, url="http://h/", length=None):
    block = b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", *http]) + b"\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{url}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {length or len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def text_of(record):
    return warc.derivatives(record)[0][1].decode()


def chunked(body, size=7):
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)) + b"0\r\n\r\n"


PAGE = "<p>two é\n lines<p>of text &amp; more".encode()
TEXT = "two é lines\nof text & more"


@pytest.mark.parametrize(
    "body,headers",
    [
        (PAGE, []),
        (gzip.compress(PAGE), [b"Content-Encoding: gzip"]),
        (gzip.compress(PAGE[:9]) + gzip.compress(PAGE[9:]), [b"content-encoding: X-GZIP"]),
        (zlib.compress(PAGE), [b"Content-Encoding: deflate"]),
        (zlib.compress(PAGE)[2:-4], [b"Content-Encoding: deflate"]),
        (chunked(PAGE), [b"Transfer-Encoding: chunked"]),
        (chunked(gzip.compress(PAGE)), [b"Transfer-Encoding: chunked", b"Content-Encoding: gzip"]),
        (gzip.compress(zlib.compress(PAGE)), [b"Content-Encoding: deflate, gzip"]),
        (PAGE, [b"Transfer-Encoding: chunked", b"Content-Encoding: gzip"]),  # undone by the archive
    ],
)
def test_bodies_are_decoded(body, headers):
    assert text_of(response(body, *headers)) == TEXT


def test_bodies_that_cannot_be_decoded_are_errors():
    for coding in (b"nonsense", b"zstd"):
        with pytest.raises(ValueError):
            warc.derivatives(response(PAGE, b"Content-Encoding: " + coding))
    cut = gzip.compress(b"<p>" + bytes(random.Random(1).choices(b"abcdef ", k=5000)))
    assert len(text_of(response(cut[: len(cut) // 2], b"Content-Encoding: gzip"))) > 1000


def test_files_in_all_states():
    a, b, c = (response(f"<p>{x} WARC/1.0 inside".encode(), url=x) for x in "abc")
    own = lambda data: [text_of(r).split()[0] if r.startswith(b"WARC/") else None for r in warc.records(data)]
    assert own(a + b + c) == own(gzip.compress(a) + gzip.compress(b) + gzip.compress(c)) == own(gzip.compress(a + b + c)) == ["a", "b", "c"]
    whole = gzip.compress(a) + gzip.compress(b) + b"trailing bytes"
    assert own(whole) == ["a", "b", None]
    broken = bytearray(gzip.compress(a) + gzip.compress(b * 3) + gzip.compress(c))
    at = len(gzip.compress(a)) + 12
    broken[at : at + 20] = b"\xff" * 20
    out = list(warc.records(bytes(broken)))
    assert text_of(out[0]).startswith("a ") and text_of(out[-1]).startswith("c ")
    with pytest.raises(ValueError):
        warc.derivatives(out[1])
    cut = list(warc.records(gzip.compress(a) + gzip.compress(b)[:-30]))
    assert text_of(cut[0]).startswith("a ") and len(cut) == 2
    with pytest.raises(ValueError):
        warc.derivatives(response(b"<p>x", length=10_000))
    assert list(warc.records(b"")) == [] and list(warc.records(b"\r\n\r\n")) == []


def test_a_broken_file_does_not_end_the_run(spark, tmp_path):
    a = response(b"<p>a")
    (tmp_path / "1.warc.gz").write_bytes(gzip.compress(a) + b"junk behind the last member")
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(a)[:-9])
    (tmp_path / "3.warc").write_bytes(a + a[:-10])
    (tmp_path / "4.warc").write_bytes(b"")
    kinds = [(r["file"][-9:], r["record_type"]) for r in warc.derive(warc.read_records(spark, str(tmp_path)), keep=["file"]).collect()]
    assert sorted(k for f, k in kinds if "1.warc" in f) == ["conversion", "error", "metadata"]
    assert sorted(k for f, k in kinds if "3.warc" in f) == ["conversion", "error", "metadata"]
    assert len(kinds) >= 7


def test_thirty_megabytes_of_members_take_seconds():
    rng = random.Random(2)
    member = gzip.compress(response(rng.randbytes(30_000)), 1)
    start = time.perf_counter()
    assert sum(1 for _ in warc.records(member * 1000)) == 1000
    assert time.perf_counter() - start < 3


@pytest.mark.parametrize("page", ["<a " * 60_000, "<a href='" * 30_000, "<script" * 50_000, "<title>" * 50_000, "<!--" * 50_000, "</head" * 50_000, "<a " * 60_000 + ">", "<p" * 100_000, "<a href=x>" * 30_000], ids=range(9))
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    warc.derivatives(response(page.encode()))
    assert time.perf_counter() - start < 3


def test_links_titles_and_headers_as_they_stand():
    page = b"<title>A &amp; B</title><a title='x>y' HREF=\"/p?a=1&amp;b\">l</a><IMG src=i.png><area href='z'><abbr href=no><!-- open > comment"
    meta = json.loads(warc.derivatives(response(page, b"Set-Cookie: a", b"set-cookie: b"))[1][1])
    assert meta["title"] == "A & B" and meta["links"] == [{"tag": "a", "url": "/p?a=1&b"}, {"tag": "img", "url": "i.png"}, {"tag": "area", "url": "z"}]
    assert meta["http-header-lines"] == [["Content-Type", "text/html; charset=utf-8"], ["Set-Cookie", "a"], ["set-cookie", "b"]]
    assert meta["source-header-lines"][:2] == [["WARC-Type", "response"], ["WARC-Record-ID", "<urn:http://h/>"]]
    assert text_of(response(b"a<!-- > b")) == "a" and text_of(response(b"<p>a < b <c")) == "a < b <c"


def test_query_equals_a_plain_version(spark, tmp_path):
    rows = [(1, "http://h/1", PAGE.decode()), (2, None, None), (3, "", ""), (3, "", ""), (4, "u", "x" * 100_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    got = sorted(tuple(r) for r in warc.op2_warc_derivatives(spark, str(tmp_path)).collect())
    import hashlib

    want = []
    for i, url, page in rows:
        record = warc.response_record(url, page, i)
        for f, body in warc.derivatives(record):
            raw = warc.record_bytes(f, body)
            want.append((i, f["WARC-Type"], f["WARC-Record-ID"], warc.record_id("response", f"{i} {url or ''}"), url or "", warc.digest(body), warc.digest((page or "").encode()), len(body), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("length", [99_999_999, 700, 3])
@pytest.mark.parametrize("which", [0, 2, 5])
def test_a_wrong_length_costs_one_record(packed, length, which):
    parts = [response(b"<p>page %d</p>" % i * 9, url=f"http://h/{i}", length=length if i == which else None) for i in range(6)]
    data = b"".join(map(gzip.compress, parts)) if packed else b"".join(parts)
    good, bad = [], 0
    for r in warc.records(data):
        try:
            good.append(warc.derivatives(r)[0][0]["WARC-Target-URI"])
        except ValueError:
            bad += 1
    if (length, which) == (3, 5):  # nothing follows: the record with trailing bytes
        assert good == [f"http://h/{i}" for i in range(6)] and bad == 1
    else:
        assert good == [f"http://h/{i}" for i in range(6) if i != which] and bad == 1


def test_a_record_that_holds_records_stays_whole():
    inner = response(b"<p>inner</p>") * 2
    records = list(warc.records(response(inner) + response(b"<p>next</p>")))
    assert len(records) == 2 and inner.strip() in records[0]

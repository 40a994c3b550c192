"""WARC derivatives: linked metadata and plain-text conversion records of response records.

`derive` takes response records as bytes and makes two records of each: a `conversion` with the
plain text of the page, and a `metadata` record with its title, links and sizes. Both refer
to the response by WARC-Refers-To, keep its target URI, date and digests, and carry digests
of their own; their identifiers are UUIDs derived from the response's, so that a repeated run
or a retried task writes the same records. Every record stands for itself, so nothing is
shuffled and no task holds more than one record beside its batch.

`read_records` reads WARC files (plain or gzip), `record_bytes` writes one record, and
`responses_from_pages` wraps a table of pages.

Chunked bodies and content codings (gzip, deflate, zstd and, where its library is installed, br) are
undone before the text is taken. Headers of the source come as lines as they stand, and by name.
Reading a file and deriving from a page both take time linear in it, however broken it is.

Defined cases: null html is an empty payload, a null url an empty target URI; a record that is
no response, is cut off, has a wrong length, lies in a broken gzip member or has a body in an unknown
coding gives one row of type `error` and no derivative, and reading goes on at the next record; a body that ends early gives the text up to there; repeated
rows give repeated records. An empty table gives an empty result. Other columns are kept by `derive`
only if they are named in `keep`.
"""

from __future__ import annotations

import base64
import hashlib
import html
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
#: Header fields of the source that a derivative repeats (fixed values).
KEPT_FIELDS = ("WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type")
#: Bytes of a file that are read at a time, and of records that a task holds before it hands them on.
PIECE, HELD = 1 << 16, 16 << 20

_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:spanwright:warc")


def record_id(kind: str, of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {of}')}>"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_bytes(fields: dict[str, str], block: bytes) -> bytes:
    """One WARC record; fields hold no line breaks (they are taken out)."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in fields.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def all_fields(head: bytes) -> dict[str, list[str]]:
    """All values of the header fields by lower-case name, in order; folded lines are joined."""
    out: dict[str, list[str]] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines():
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().decode("latin-1").lower(), []).append(value.strip().decode("utf-8", "replace"))
    return out


def parse_fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of a name counts."""
    return {k: v[0] for k, v in all_fields(head).items()}


def kept_fields(head: bytes) -> dict[str, str | list[str]]:
    """Header fields by lower-case name, sorted: the value, or the list of them where a field is repeated."""
    return {k: v if len(v) > 1 else v[0] for k, v in sorted(all_fields(head).items())}


def header_lines(head: bytes) -> list[list[str]]:
    """[name, value] of the header fields as they stand: order, case and repeats are kept, folded lines are joined."""
    lines = (line.partition(b":") for line in re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines())
    return [[name.strip().decode("latin-1"), value.strip().decode("utf-8", "replace")] for name, colon, value in lines if colon]


_END = re.compile(rb"\r?\n\r?\n")


def split_head(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The header from `at` on, and where its block begins."""
    end = _END.search(data, at)
    return (data[at : end.start()], end.end()) if end else (data[at:], len(data))


def inflated(data: bytes) -> Iterator[bytes | None]:
    """The contents of a gzip file in pieces, member by member. None stands where a member is broken;
    reading goes on at the next thing that looks like a member."""
    view, at = memoryview(data), 0
    while at < len(data):
        inflate = zlib.decompressobj(31)
        try:
            while at < len(data) and not inflate.eof:
                piece = view[at : at + PIECE]
                out = inflate.decompress(piece)
                at += len(piece) - len(inflate.unused_data)
                if out:
                    yield out
            if not inflate.eof:
                yield None
        except zlib.error:
            yield None
            at = data.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return


def records(data: bytes) -> Iterator[bytes]:
    """The records of a file, each with its header; a gzip file may hold a member for each record.

    One pass, which holds the record at hand beside the file. A record that is cut off, has no length
    or lies in a broken member comes as far as it can be read; `derivatives` tells it from whole ones.
    """
    held, need = bytearray(), 0
    for piece in inflated(data) if data[:2] == b"\x1f\x8b" else (data[i : i + PIECE] for i in range(0, len(data), PIECE)):
        held += piece or b""
        if piece is None or len(held) >= need:
            need = yield from _whole_records(held)
        if piece is None:  # what is held can't be completed
            left = list(_whole_records(held, last=True))
            yield from left
            if not left or _is_whole(left[-1]):  # the broken member itself
                yield b""
            held.clear()
            need = 0
    yield from _whole_records(held, last=True)


#: A line break before the first line of a record.
_NEXT = re.compile(rb"\n(?=WARC/\d\.\d\r?\n)")
#: What may lie between a record and the next one, and the begin of that.
_AFTER = 16


def _is_whole(record: bytes) -> bool:
    end = _END.search(record)
    size = parse_fields(record[: end.start()]).get("content-length", "") if end else ""
    return size.isdigit() and len(record) >= end.end() + int(size)


def _whole_records(held: bytearray, last: bool = False) -> Iterator[bytes]:
    """Take the whole records off the front of `held`; returns how long it must be for another try.

    A record is whole if the next one, or the end, follows where its length says. A length that is wrong ends its
    record at the next header; the records from there on are read. `last`: nothing more will come.
    """
    while True:
        begin = held.find(b"WARC/")
        if begin < 0:
            if last and held.strip():
                yield bytes(held)
            if last or not held.strip():
                held.clear()
            return 2 * len(held)
        if held[:begin].strip():  # no record: handed on as it is
            yield bytes(held[:begin])
        del held[:begin]
        end = _END.search(held)
        if end is None:
            if last:
                yield bytes(held)
                held.clear()
            return 2 * len(held)
        size = parse_fields(bytes(held[: end.start()])).get("content-length", "")
        upto = end.end() + (int(size) if size.isdigit() else 0)
        if len(held) < upto + _AFTER and not last:
            return upto + _AFTER
        after = bytes(held[upto : upto + _AFTER]).lstrip(b"\r\n")
        wrong = len(held) < upto or (after and not b"WARC/".startswith(after[:5]))
        following = _NEXT.search(held, end.end()) if wrong else None
        if following:
            upto = following.end()
        elif wrong and not last:
            return 2 * len(held)
        yield bytes(held[:upto])
        del held[:upto]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, position, record (bytes) of WARC files; a file (of less than 2 GB) is the unit of work, as gzip can't be split."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                made, first, size = [], 0, 0
                for r in itertools.chain(records(content.as_py()), [None]):
                    if r is not None:
                        made.append(r)
                        size += len(r)
                    if made and (r is None or size > HELD or len(made) >= 200):
                        at = pa.array(range(first, first + len(made)), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(made)), at, pa.array(made, pa.binary())], names=["file", "position", "record"])
                        first, made, size = first + len(made), [], 0

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(run, "file string, position long, record binary")


def unchunked(body: bytes) -> bytes:
    """A chunked body in one piece; one that isn't chunked (archives may have undone it) as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at, at + 4096)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1


def _inflate(body: bytes, bits: int) -> bytes:
    d = zlib.decompressobj(bits)
    return d.decompress(body) + d.flush()


def decoded_body(body: bytes, codings: list[str]) -> bytes:
    """A body without its content codings; one that is cut off comes as far as it goes. ValueError if a coding is unknown or does not fit."""
    for coding in reversed([c.strip().lower() for value in codings for c in value.split(",") if c.strip()]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = b"".join(x for x in inflated(body) if x) if body[:2] == b"\x1f\x8b" else body
            elif coding == "deflate":
                try:
                    body = _inflate(body, 15)
                except zlib.error:
                    body = _inflate(body, -15)
            elif coding == "br":
                import brotli

                body = brotli.decompress(body)
            elif coding == "zstd":
                import zstandard

                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif coding != "identity":
                raise ValueError(f"content coding {coding} is unknown")
        except ValueError:
            raise
        except Exception as e:  # each library has errors of its own, and one may be missing
            raise ValueError(f"content coding {coding}: {e}") from e
    return body


_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body)|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|header|footer|aside|main|form|blockquote|pre|hr|body)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>")
_SPACE = re.compile(r"[^\S\n]+")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_LINKING = re.compile(r"<(a|area|link|img|script|iframe)(?=[\s/])", re.I)
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TARGET = re.compile(r"(?:^|\s)(?:href|src)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def closed(page: str) -> str:
    """`page` with no open tag behind the last bracket, so that every tag that is looked for ends."""
    last = page.rfind(">") + 1
    return page[:last] + page[last:].partition("<!--")[0].replace("<", "&lt;")


def plain_text(page: str) -> str:
    """All visible text of a closed page, one line per block."""
    page = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", page).replace("\r", " ").replace("\n", " ")))
    lines = (_SPACE.sub(" ", x).strip() for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(page: str) -> str | None:
    begin = _TITLE.search(page)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return " ".join(html.unescape(page[begin.end() : end.start()]).split()) if end else None


def links_of(page: str) -> list[dict[str, str]]:
    """tag and url of the links of a closed page, in order; each tag is read once."""
    out, at, quoted = [], 0, True
    while m := _LINKING.search(page, at):
        rest = _REST.match(page, m.end()) if quoted else None
        if rest is None:  # a quote that never ends: from here on tags end at the next bracket
            quoted, end = False, page.find(">", m.end())
        else:
            end = rest.end(1)
        at = end + 1
        if target := _TARGET.search(page[m.end() : end]):
            out.append({"tag": m[1].lower(), "url": html.unescape(target[1].strip("\"'"))})
    return out


def _decoded(payload: bytes, content_type: str) -> str:
    found = _CHARSET.search(content_type) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def derivatives(record: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The conversion and the metadata record of a response; ValueError if it is none."""
    head, begin = split_head(record)
    source = parse_fields(head)
    if not record.startswith(b"WARC/") or source.get("warc-type") != "response" or not source.get("warc-record-id"):
        raise ValueError("no response record")
    size = source.get("content-length", "")
    if not size.isdigit() or len(record) - begin < int(size):
        raise ValueError("the record is cut off or has no length")
    if record[begin + int(size) :].strip(b"\r\n"):
        raise ValueError("the record is longer than its length")
    block = record[begin : begin + int(size)]
    http_head, payload_at = split_head(block)
    http = all_fields(http_head)
    payload = block[payload_at:]
    if any("chunked" in x.lower() for x in http.get("transfer-encoding", ())):
        payload = unchunked(payload)
    payload_digest = source.get("warc-payload-digest") or digest(payload)
    page = closed(_decoded(decoded_body(payload, http.get("content-encoding", [])), (http.get("content-type") or [""])[0]))
    of = source["warc-record-id"]
    linked = {
        "WARC-Target-URI": source.get("warc-target-uri", ""),
        "WARC-Date": source.get("warc-date") or DATE,
        "WARC-Refers-To": of,
        "WARC-Refers-To-Target-URI": source.get("warc-target-uri", ""),
        "WARC-Refers-To-Date": source.get("warc-date") or DATE,
    } | {k: source[k.lower()] for k in KEPT_FIELDS if k.lower() in source}
    text = plain_text(page).encode("utf-8", "surrogatepass")
    status = http_head.split(b"\r\n", 1)[0].decode("latin-1").split(" ", 2)
    conversion_id, metadata_id = record_id("conversion", of), record_id("metadata", of)
    about = {
        "refers-to": of,
        "conversion": conversion_id,
        "source-block-digest": source.get("warc-block-digest") or digest(block),
        "source-payload-digest": payload_digest,
        "source-headers": kept_fields(head),
        "http-status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None,
        "source-header-lines": header_lines(head),
        "http-headers": kept_fields(http_head),
        "http-header-lines": header_lines(http_head),
        "payload-length": len(payload),
        "text-length": len(text),
        "title": title_of(page),
        "links": links_of(page),
    }
    meta = json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    out = []
    for kind, i, mime, body in (("conversion", conversion_id, "text/plain", text), ("metadata", metadata_id, "application/json", meta)):
        fields = {"WARC-Type": kind, "WARC-Record-ID": i, **linked, "WARC-Source-Payload-Digest": payload_digest}
        if kind == "metadata":
            fields["WARC-Concurrent-To"] = conversion_id
        fields |= {"WARC-Block-Digest": digest(body), "Content-Type": mime}
        out.append((fields, body))
    return out


def derive(responses: DataFrame, record: str = "record", keep: list[str] | None = None, with_bytes: bool = True) -> DataFrame:
    """`keep`, record_type, record_id, refers_to, target_uri, block_digest, source_digest, content_length, error, record."""
    keep = keep or []
    kept = responses.select(*keep).schema
    own = ["record_type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} string" for c in own] + ["content_length long, error string, record binary"])

    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            at, rows, size = [], [], 0
            for i in range(batch.num_rows):
                try:
                    made = derivatives(batch.column(len(keep))[i].as_py() or b"")
                except ValueError as e:
                    at.append(i)
                    rows.append(("error", None, None, None, None, None, 0, str(e), None))
                    made = []
                for f, body in made:
                    at.append(i)
                    ids = (f["WARC-Type"], f["WARC-Record-ID"], f["WARC-Refers-To"], f["WARC-Target-URI"], f["WARC-Block-Digest"], f["WARC-Source-Payload-Digest"])
                    rows.append((*ids, len(body), None, record_bytes(f, body) if with_bytes else None))
                    size += len(body)
                if rows and (i + 1 == batch.num_rows or len(rows) >= 400 or size > HELD):
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    kept_columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*kept_columns, *columns], names=[*keep, *own, "content_length", "error", "record"])
                    at, rows, size = [], [], 0

    out = responses.select(*keep, record).mapInArrow(run, schema)
    return out if with_bytes else out.drop("record")


def response_record(url: str | None, page: str | None, key: object) -> bytes:
    """A response record of a page; its id follows from key and url."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id("response", f"{key} {url or ''}"),
        "WARC-Target-URI": url or "",
        "WARC-Date": DATE,
        "WARC-Block-Digest": digest(block),
        "WARC-Payload-Digest": digest(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    return record_bytes(fields, block)


def responses_from_pages(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """key, record: every page as a response record."""
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                k, u, t = (batch.column(i).slice(begin, 500) for i in range(3))
                made = [response_record(*x) for x in zip(u.to_pylist(), t.to_pylist(), k.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([k, pa.array(made, pa.binary())], names=[key, "record"])

    return pages.select(key, url, text).mapInArrow(run, f"`{key}` {kind}, record binary")


def op2_warc_derivatives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = derive(responses_from_pages(pages), keep=["page_id"])
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))

"""WARC derivatives: metadata and plain-text conversion records from responses.

A record is a row: its identifier, type, target, date, the record it refers to, its digests, its content type, its other headers, and its block. From each response record come a
metadata record (what the server said, title, language, outlinks) and a conversion record (the text of the page); both name the response in ``refers_to`` and carry its
target, date, source headers and payload digest. ``parse`` reads records from the bytes of WARC files, ``serialize`` writes them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import raw

RECORD = ("record_id string, type string, target_uri string, date string, refers_to string, payload_digest string, block_digest string, "
          "content_type string, headers map<string,string>, block binary")
_SCHEMA = pa.schema([(n, pa.string()) for n in ("record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "block_digest", "content_type")]
                    + [("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_FIELDS = {"WARC-Record-ID": "record_id", "WARC-Type": "type", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Refers-To": "refers_to",
           "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type"}
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:entrylake:warc")
#: Elements whose text is not shown, and elements that end a line (fixed values).
_HIDDEN = "script|style|noscript|template|head|svg"
_BREAKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul"
_DROP = re.compile(rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>", re.I | re.S)
_BREAK = re.compile(rf"</?(?:{_BREAKS})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^>]*>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(kind: str, refers_to: str) -> str:
    """The same identifier whenever the same response is derived again."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, kind + ' ' + refers_to)}>"


def page_text(page: str) -> str:
    """Visible text of an HTML page: a line for each block of text, blanks run together."""
    shown = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page).replace("\r", " ").replace("\n", " ")))
    lines = (" ".join(line.split()) for line in html.unescape(shown).split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str) -> list[str]:
    return [html.unescape(next(x for x in m if x) if any(m) else "") for m in _LINK.findall(_DROP.sub(" ", page))]


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = headers[-1][0], f"{headers[-1][1]} {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            headers.append((name.strip(), value.strip()))
    return status, headers, payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    """Payload as text: chunks are joined, gzip and deflate undone, bytes read as the charset that header or page names, else UTF-8."""
    named = {n.lower(): v for n, v in headers}
    if "chunked" in named.get("transfer-encoding", "").lower():
        out, rest = [], payload
        while m := re.match(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n", rest):
            size = int(m[1], 16)
            if not size:
                break
            out.append(rest[m.end():m.end() + size])
            rest = rest[m.end() + size + 2:]
        payload = b"".join(out) if out else payload
    coding = named.get("content-encoding", "").lower()
    try:
        payload = zlib.decompressobj(47).decompress(payload) if coding in ("gzip", "x-gzip", "deflate") else payload
    except zlib.error:
        pass
    found = _CHARSET.search(named.get("content-type", "").encode()) or _CHARSET.search(payload[:2048])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    status, headers, payload = split_http(response["block"] or b"")
    page = decoded(headers, payload)
    source = response["payload_digest"] or digest(payload)
    title, lang = _TITLE.search(page), _LANG.search(page)
    fields = [("source-status", status), *((f"source-header-{n.lower()}", v) for n, v in headers),
              ("source-content-type", response["content_type"] or ""), ("source-payload-digest", source),
              ("source-length", str(len(payload))), ("title", " ".join(html.unescape(title[1]).split()) if title else ""),
              ("language", lang[1].lower() if lang else ""), *(("outlink", link) for link in links(page))]
    clean = lambda v: re.sub(r"[\r\n]+", " ", v).strip()
    blocks = {"metadata": ("application/warc-fields", "".join(f"{n}: {clean(v)}\r\n" for n, v in fields if clean(v)).encode()),
              "conversion": ("text/plain;charset=utf-8", page_text(page).encode("utf-8", "replace"))}
    out = []
    for kind, (content_type, block) in blocks.items():
        # A response without an identifier is named by its target and content.
        refers_to = response["record_id"] or f"<urn:uuid:{uuid.uuid5(_NAMESPACE, (response['target_uri'] or '') + source)}>"
        kept = {n: v for n, v in (response["headers"] or []) if n.lower() not in ("content-length", "warc-truncated")}
        out.append({"record_id": derived_id(kind, refers_to), "type": kind, "target_uri": response["target_uri"], "date": response["date"],
                    "refers_to": refers_to, "payload_digest": source if kind == "metadata" else digest(block), "block_digest": digest(block),
                    "content_type": content_type, "headers": [*(kept | {"WARC-Source-Payload-Digest": source}).items()], "block": block})
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for every response record of ``records``; others are passed over. Null blocks count as empty ones, null targets and dates stay
    null, repeated responses are derived each (to the same identifiers), an empty table gives none, other columns are ignored."""
    names = _SCHEMA.names

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = [d for row in zip(*(c.to_pylist() for c in batch.columns)) for d in derive(dict(zip(names, row)))]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in made], t) for n, t in zip(names, _SCHEMA.types)], schema=_SCHEMA)
    return records.where("type = 'response'").select(*names).mapInArrow(run, RECORD)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages (page_id, url, html), as a crawler would have written them; a null page is an empty one."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.encode(head, "utf-8"), body)
    hexed = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    part = lambda a, n: F.substring(hexed, a, n)
    sha = lambda x: F.concat(F.lit("sha256:"), F.sha2(x, 256))
    null = F.lit(None).cast("string")
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">")).alias("record_id"),
        F.lit("response").alias("type"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), null.alias("refers_to"),
        sha(body).alias("payload_digest"), sha(block).alias("block_digest"), F.lit("application/http; msgtype=response").alias("content_type"),
        F.create_map(F.lit("WARC-Source-Page"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("headers"), block.alias("block"))


def write_record(record: dict) -> bytes:
    """One record in WARC 1.1 form."""
    lines = ["WARC/1.1"] + [f"{name}: {record[field]}" for name, field in _FIELDS.items() if record[field] is not None]
    lines += [f"{n}: {v}" for n, v in (record["headers"] or [])] + [f"Content-Length: {len(record['block'] or b'')}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (record["block"] or b"") + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or as gzip members; reading ends at the first one that is cut off or damaged."""
    try:
        yield from _read(data)
    except (EOFError, gzip.BadGzipFile, zlib.error, ValueError):
        return


def _read(data: bytes) -> Iterator[dict]:
    stream: io.BufferedIOBase = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        record: dict = dict.fromkeys(_SCHEMA.names)
        extra: list[tuple[str, str]] = []
        size = 0
        while (line := stream.readline()).strip():
            if not line.endswith(b"\n"):
                return
            name, _, value = line.decode("utf-8", "replace").partition(":")
            value = value.strip()
            if name.lower() == "content-length":
                size = int(value)
            elif (field := next((f for n, f in _FIELDS.items() if n.lower() == name.lower()), None)):
                record[field] = value
            else:
                extra.append((name, value))
        if not line:
            return
        record["block"] = stream.read(size)
        if len(record["block"]) < size:
            return
        record["headers"] = extra
        yield record


def parse(files: DataFrame) -> DataFrame:
    """Records of the files of ``spark.read.format("binaryFile")`` (column content); a null content has none."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for data in raw(batch.column(0)):
                made = []
                for record in read_records(data):
                    made.append(record)
                    if len(made) == 1000:
                        yield _batch(made)
                        made = []
                if made:
                    yield _batch(made)
    return files.select("content").mapInArrow(run, RECORD)


def _batch(made: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in made], t) for n, t in zip(_SCHEMA.names, _SCHEMA.types)], schema=_SCHEMA)


def serialize(records: DataFrame, compress: bool = True) -> DataFrame:
    """record_id and ``warc``, the bytes of each record, by default as a gzip member; joined in any order they are a WARC file."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = [write_record(dict(zip(_SCHEMA.names, row))) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([gzip.compress(m, mtime=0) if compress else m for m in made], pa.binary())],
                                             names=["record_id", "warc"])
    return records.select(*_SCHEMA.names).mapInArrow(run, "record_id string, warc binary")

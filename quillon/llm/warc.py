"""WARC derivatives: metadata and plain-text conversion records for response records.

Derived records refer to their response by its identifier and keep its target, date and digests;
the fields of the HTTP response are kept in the metadata record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.html_text import outline

# The charset of the HTTP field, and that of a meta element anywhere in the page.
_CHARSET = re.compile(r"charset\s*+=\s*+[\"']?\s*+([\w.-]+)", re.I)
_META = re.compile(rb"<meta\b[^<>]*?\bcharset\s*+=\s*+[\"']?\s*+([\w.-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """An identifier that is the same in every run, so that tasks that are tried again write the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def make_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers, block, whether the block is as long as its header says) of each record.

    Stops at what is no record; header names are as written, a repeated one keeps its first value.
    """
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip(), value.strip())
        size = headers.get("Content-Length", "0")
        size = int(size) if size.isdigit() else 0
        block = data[end + 4 : end + 4 + size]
        yield headers, block, len(block) == size
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, fields, body) of an HTTP response; a block without a head is all body."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def response_record(key: object, url: str | None, page: str | None, date: str) -> bytes:
    """A response record for a fetched page."""
    body = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url)), ("WARC-Target-URI", url or ""), ("WARC-Date", date), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return make_record(headers, block)


def derive(record: bytes | None) -> Iterator[dict]:
    """The metadata and the conversion record of each response record in a value."""
    for source, block, complete in parse_records(bytes(record)) if record else ():
        if source.get("WARC-Type", "").lower() == "response":
            yield _derived(source, block, complete)


def _derived(source: dict[str, str], block: bytes, complete: bool) -> dict:
    status, fields, body = split_http(block)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    charset = m[1] if (m := _CHARSET.search(kind)) else m[1].decode("latin-1") if (m := _META.search(body)) else "utf-8"
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    url, own = source.get("WARC-Target-URI", ""), source.get("WARC-Record-ID", "")
    text, title, language, targets = outline(page)
    links = {}
    for raw in targets:
        try:
            links[urljoin(url, raw)] = True
        except ValueError:
            links[raw] = True
    lines = [("status", status), *((f"http-{k.lower()}", v) for k, v in fields), ("charset", charset)]
    lines += [(k, v) for k, v in (("title", title), ("language", language)) if v]
    lines += [("outlink", x) for x in links]
    about = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in lines).encode("utf-8", "surrogatepass")
    plain = text.encode("utf-8", "surrogatepass")
    given = source.get("WARC-Payload-Digest")
    kept = [("WARC-Target-URI", url), ("WARC-Date", source.get("WARC-Date", "")), ("WARC-Refers-To", own), ("WARC-Source-Payload-Digest", given or digest(body)), ("WARC-Source-Block-Digest", source.get("WARC-Block-Digest", digest(block)))]
    ids = {k: record_id(k, own, url) for k in ("metadata", "conversion")}
    valid = None if not given or not given.lower().startswith("sha1:") else given.lower() == digest(body).lower()
    out = {"url": url, "response_id": own, "payload_digest": given or "", "digest_valid": valid, "complete": complete, "n_links": len(links), "text": text}
    for name, content, data in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", plain)):
        out |= {f"{name}_id": ids[name], f"{name}_digest": digest(data)}
        out[name] = make_record([("WARC-Type", name), ("WARC-Record-ID", ids[name]), *kept, ("WARC-Block-Digest", out[f"{name}_digest"]), ("Content-Type", content)], data)
    return out


_FIELDS = {"url": "string", "response_id": "string", "payload_digest": "string", "digest_valid": "boolean", "complete": "boolean", "n_links": "long", "text": "string", "metadata_id": "string", "metadata_digest": "string", "metadata": "binary", "conversion_id": "string", "conversion_digest": "string", "conversion": "binary"}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(id, record): a response record for each row; null html is an empty body, a null url an empty target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response_record(*x, date) for x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["id", "record"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, record binary")


def derivatives(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """A row for each response record: its identifiers, digests, text, and both derived records as bytes.

    ``digest_valid`` is null where the record has no SHA-1 digest to compare, ``complete`` false where
    its block is cut short. A value may hold several records. Null, broken and other records give no
    rows; repeated records give equal rows. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, d) for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for d in derive(r)]
            kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], b.schema.field(0).type), *(pa.array([d[k] for _, d in rows], kinds[t]) for k, t in _FIELDS.items())], ["id", *_FIELDS])

    return records.select(id_col, record_col).mapInArrow(run, f"id {records.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, t in _FIELDS.items()))


def write_warc(records: DataFrame, path: str, record_col: str = "record", compression: str = "none") -> None:
    """Write records as WARC files, one for each partition, through Spark's own file output.

    A record ends with a line break, which the text output writes; bytes pass through unchanged.
    """
    body = F.expr(f"substring({record_col}, 1, length({record_col}) - 1)").cast("string")
    records.where(F.col(record_col).isNotNull()).select(body.alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)

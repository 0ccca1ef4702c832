"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .html_text import Lines, parsed

#: Bytes that are inflated at once, bytes of headers at most, and bytes of records whose derivatives are handed on together.
PART_BYTES, HEAD_BYTES, FILE_BYTES = 1 << 20, 1 << 20, 8 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class Whole(Lines):
    """All lines of a page: nothing goes but scripts, styles, templates and comments."""

    def is_dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        return tag in ("script", "style", "template")


def plain_text(html: str) -> str:
    """The text of a whole page, white space collapsed, lines joined by blank lines."""
    return "\n\n".join(t for t, _, _ in parsed(html, Whole).lines) if html else ""


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """The same for the same parts, so that a task that runs again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record. Line ends within a header's value become spaces."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(data: bytes) -> Iterator[bytes]:
    """A file's bytes in parts: those of its gzip members or zstd frames, or as they are. What can't be read on ends it."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
        try:
            while part := reader.read(PART_BYTES):
                yield part
        except zstandard.ZstdError:
            return
        return
    rest = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for i in range(0, len(rest), PART_BYTES):
            yield bytes(rest[i : i + PART_BYTES])
        return
    while len(rest):
        member, at = zlib.decompressobj(31), 0
        try:
            # never more than a part at once, however well it was compressed
            held = b""
            while not member.eof and (held or at < len(rest)):
                if not held:
                    held, at = bytes(rest[at : at + PART_BYTES]), at + PART_BYTES
                yield member.decompress(held, PART_BYTES)
                held = member.unconsumed_tail
        except zlib.error:
            return
        left = len(member.unused_data)
        rest = rest[min(at, len(rest)) - left :] if left else rest[min(at, len(rest)) :]


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]] | None, bytes]]:
    """The records of a file's bytes, compressed or not, one after another: headers as they are, without Content-Length, and block.

    What is no record gives None and a message; reading goes on at the next place that looks like one. Only the record at hand is held.
    """
    parts, held, at, done = inflated(data), bytearray(), 0, False

    def more() -> bool:
        nonlocal done
        part = next(parts, None)
        done = part is None
        held.extend(part or b"")
        return not done

    def drop(n: int) -> None:
        nonlocal at
        del held[:n]
        at += n

    while True:
        while len(held) < 5 and more():
            pass
        blank = len(held) - len(held.lstrip(b"\r\n"))
        if blank:
            drop(blank)
            continue
        if not held:
            return
        end = held.find(b"\r\n\r\n")
        while end < 0 and len(held) < HEAD_BYTES and more():
            end = held.find(b"\r\n\r\n")
        headers, fault = _headers(bytes(held[:end])) if end >= 0 and held.startswith(b"WARC/") else (None, "no WARC record")
        if headers is not None:
            n = int(next(v for k, v in headers if k.lower() == "content-length"))
            while len(held) < end + 4 + n and more():
                pass
            if len(held) >= end + 4 + n:
                yield [h for h in headers if h[0].lower() != "content-length"], bytes(held[end + 4 : end + 4 + n])
                drop(end + 4 + n)
                continue
            fault = f"a block of {n} bytes ends after {len(held) - end - 4}"
        yield None, f"{fault} at byte {at}".encode()
        drop(1)
        while (found := held.find(b"\r\n\r\nWARC/")) < 0:
            drop(max(0, len(held) - 8))
            if not more():
                return
        drop(found + 4)


def _headers(head: bytes) -> tuple[list[tuple[str, str]] | None, str]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    sizes = [v for k, v in out if k.lower() == "content-length"]
    return (out, "") if sizes and sizes[0].isascii() and sizes[0].isdigit() else (None, "no Content-Length")


def http_parts(block: bytes) -> tuple[list[str], bytes]:
    """Header lines and body of an HTTP message; all is body where there are no headers."""
    if not block.startswith(b"HTTP/"):
        return [], block
    head, found, body = block.partition(b"\r\n\r\n")
    return head.decode("latin-1").split("\r\n"), body if found else b""


def unchunked(body: bytes) -> bytes:
    """A body without the marks of chunked transfer; what isn't so marked stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def decoded(http: list[str], body: bytes) -> tuple[str, str, list[str]]:
    """The text of a message, its media type and what kept it from being read; transfer and content encodings are undone and the character set is found."""
    h: dict[str, str] = {}
    for line in http[1:]:
        k, _, v = line.partition(":")
        h[k.strip().lower()] = v.strip()
    faults = []
    if "chunked" in h.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for name in reversed([x.strip().lower() for x in h.get("content-encoding", "").split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = b"".join(inflated(body)) if body[:2] == b"\x1f\x8b" else body
            elif name == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
            elif name == "zstd":
                body = b"".join(inflated(body))
            elif name != "identity":
                return "", "", [f"content encoding {name} is not known"]
        except zlib.error as e:
            faults.append(f"content encoding {name}: {e}")
    kind, _, rest = h.get("content-type", "").partition(";")
    named = _CHARSET.search(rest.encode("latin-1", "replace")) or _CHARSET.search(b" ".join(_META.findall(body[:4096])))
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace"), kind.strip().lower(), faults
    try:
        name = codecs.lookup(named.group(1).decode()).name if named else ""
    except (LookupError, UnicodeDecodeError):
        name = ""
    if not name:
        try:
            return body.decode(), kind.strip().lower(), faults
        except UnicodeDecodeError:
            # as browsers do where nothing is told
            name = "utf-8" if named or _is_utf8(body) else "cp1252"
    # browsers read the names of these as the wider set
    return body.decode({"iso8859-1": "cp1252", "ascii": "cp1252"}.get(name, name), "replace"), kind.strip().lower(), faults


def _is_utf8(body: bytes) -> bool:
    """Whether most of the bytes beyond ASCII are UTF-8, as in a text with a few broken characters."""
    return 2 * body.decode("utf-8", "replace").count("\ufffd") < sum(1 for _ in re.finditer(rb"[\x80-\xff]+", body))


_CHARSET, _META = re.compile(rb"(?i)charset\s*=\s*[\"']?\s*([a-z0-9_.:-]+)"), re.compile(rb"(?i)<meta[^>]*>")
HTML = ("", "text/html", "application/xhtml+xml")


def response(uri: str | None, html: str | None, date: str) -> tuple[list[tuple[str, str]], bytes]:
    """A response record of a page as a crawler would write it."""
    body = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", uri or "", digest(block))), ("WARC-Date", date), ("WARC-Target-URI", uri or ""), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return headers, block


def derived(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response record, each of which refers to it; none of other records.

    The metadata record keeps the source's headers and those of its HTTP message. Bodies are read as their encodings and character sets tell. A body that isn't text, or
    whose encoding isn't known, has an empty conversion, and its metadata tells why (conversion-fault).
    """
    h = {k.lower(): v for k, v in headers}
    if h.get("warc-type") != "response":
        return []
    source, uri, date = h.get("warc-record-id", ""), h.get("warc-target-uri", ""), h.get("warc-date", "")
    http, body = http_parts(block)
    text, kind, faults = decoded(http, body)
    if kind in HTML:
        text = plain_text(text)
    elif not kind.startswith("text/"):
        text, faults = "", [*faults, f"{kind} is not text"]
    text = text.encode("utf-8", "replace")
    conversion_id, metadata_id = record_id("conversion", source), record_id("metadata", source)
    fields = [*(f"source-{k.lower()}: {v}" for k, v in headers), *(f"http-{x}" for x in http), f"source-payload-length: {len(body)}", f"conversion-record: {conversion_id}", f"conversion-block-digest: {digest(text)}", f"conversion-length: {len(text)}", *(f"conversion-fault: {x}" for x in faults)]
    meta = "".join(f"{' '.join(x.split())}\r\n" for x in fields).encode()
    shared = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source)]
    told = [("WARC-Source-Payload-Digest", h.get("warc-payload-digest") or digest(body)), ("WARC-Source-Block-Digest", h.get("warc-block-digest") or digest(block))]
    return [
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *shared, ("WARC-Block-Digest", digest(meta)), *told, ("Content-Type", "application/warc-fields")], meta),
        ([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *shared, ("WARC-Block-Digest", digest(text)), *told, ("Content-Type", "text/plain; charset=utf-8")], text),
    ]


SCHEMA = "id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_block_digest string, block string"


def _row(i, headers: list[tuple[str, str]], block: bytes) -> tuple:
    h = dict(headers)
    return (i, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"], h["Content-Type"], len(block), h["WARC-Block-Digest"], h["WARC-Source-Payload-Digest"], h["WARC-Source-Block-Digest"], block.decode())


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if n in ("id", "content_length") else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _derive(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                yield _table([_row(i, *d) for i, u, h in zip(*(part.column(x).to_pylist() for x in range(3)), strict=True) for d in derived(*response(u, h, date))])

    return run


def derivatives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Two rows per page, a metadata and a conversion record, with the headers as columns and the block as text.

    A page is wrapped as the response record that a crawler writes, dated ``date``. Null html is an empty body and a null url an empty target.
    Repeated rows give equal records each; other columns are ignored.
    """
    ship(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("u"), F.col(html_col).alias("h"))
    return src.mapInArrow(_derive(date), SCHEMA).withColumnRenamed("id", id_col)


def derivatives_of_files(spark, path: str) -> DataFrame:
    """The derivatives of all response records in WARC files (gzip, zstd or neither) under a path of any store that Spark reads; id is null.

    A task holds one file as it is stored (2 GB at most, the limit of a value in Spark) and of what is inflated one record. What is no record, or ends too early, is a row of type
    error whose block tells what and where; the file's other records are read all the same.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in records(batch.column(0)[k].as_py()):
                    rows += [(None, "error", *[None] * 5, len(block), *[None] * 3, block.decode())] if headers is None else [_row(None, *d) for d in derived(headers, block)]
                    size += len(block)
                    if size > FILE_BYTES:
                        yield _table(rows)
                        rows, size = [], 0
                if rows:
                    yield _table(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, SCHEMA)


def files(rows: DataFrame) -> DataFrame:
    """The bytes of a gzip WARC member for each derivative row (column member); members of a partition, joined, are a file. Rows of errors give none."""
    names = ["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "source_payload_digest", "source_block_digest", "block"]
    keys = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest", "WARC-Source-Payload-Digest", "WARC-Source-Block-Digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in zip(*(batch.column(n).to_pylist() for n in names), strict=True) if r[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(record(list(zip(keys, r[:-1], strict=True)), r[-1].encode()), mtime=0) for r in rows], pa.binary())], ["member"])

    return rows.select(*names).mapInArrow(run, "member binary")

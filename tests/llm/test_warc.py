"""WARC derivatives: records built here byte by byte, encodings, broken files."""

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib

import pyarrow.parquet as pq
import zstandard

from vigilspark.llm import entries, warc
from vigilspark.llm.warc import derivatives_of_files, derived, records


def sha(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def urn(*parts):
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID('6ba7b811-9dad-11d1-80b4-00c04fd430c8'), chr(0).join(parts))}>"


BLOCK = r"</?(?:html|head|title|body|nav|ul|ol|li|div|article|section|h1|h2|h3|p|footer|aside|header|main|form|table|tr|td|hr)\b[^>]*>"


def text_of(page):
    """All blocks of a page but scripts, styles and comments, by patterns alone."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    page = re.sub(r"(?s)<(script|style)\b.*?</\1>", "", page)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in re.split(BLOCK, page))
    return "\n\n".join(t for t in texts if t)


def test_query_equals_records_built_byte_by_byte(spark):
    t = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pydict()
    want = {}
    for i, url, page in zip(t["page_id"], t["url"], t["html"], strict=True):
        body = (page or "").encode()
        http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(len(body)).encode()]
        block = b"\r\n".join(http) + b"\r\n\r\n" + body
        source, date = urn("response", url or "", sha(block)), "1970-01-01T00:00:00Z"
        text = text_of(page or "").encode()
        headers = {"warc-type": "response", "warc-record-id": source, "warc-date": date, "warc-target-uri": url or "", "warc-payload-digest": sha(body), "warc-block-digest": sha(block), "content-type": "application/http; msgtype=response"}
        fields = [f"source-{k}: {v}" for k, v in headers.items()] + [f"http-{x.decode()}" for x in http]
        fields += [f"source-payload-length: {len(body)}", f"conversion-record: {urn('conversion', source)}", f"conversion-block-digest: {sha(text)}", f"conversion-length: {len(text)}"]
        for kind, own, media in (("metadata", "".join(f"{f}\r\n" for f in fields).encode(), "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
            want[i, kind] = (urn(kind, source), source, url, date, media, len(own), sha(own), sha(body), sha(block), own.decode())
    got = entries.op8_warc(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[2:] == want[r.page_id, r.warc_type]


def converted(head, body):
    (_, meta), (_, text) = derived([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)
    return text.decode(), meta.decode()


def test_encodings_and_character_sets():
    page, want = "<p>café naïve €5</p>", "café naïve €5"
    raw = page.encode("cp1252")
    assert converted(b"Content-Type: text/html; charset=ISO-8859-1", raw)[0] == want
    assert converted(b"Content-Type: text/html", b'<meta charset="windows-1252">' + raw)[0] == want
    assert converted(b"Content-Type: text/html", b'<meta http-equiv=Content-Type content="text/html; charset=latin1">' + raw)[0] == want
    assert converted(b"Content-Type: text/html", raw)[0] == converted(b"X: y", page.encode())[0] == want
    assert converted(b"Content-Type: text/html; charset=nonsense", page.encode())[0] == want
    assert converted(b"Content-Type: text/html; charset=shift_jis", "<p>日本語</p>".encode("shift_jis"))[0] == "日本語"
    assert converted(b"Content-Type: text/html", b"\xff\xfe" + page.encode("utf-16-le"))[0] == want
    assert converted(b"Content-Type: text/html", page.encode() * 3 + b"\xff")[0].startswith(want)
    utf8 = page.encode()
    deflate = zlib.compressobj(wbits=-15)
    for name, data in ((b"gzip", gzip.compress(utf8)), (b"x-gzip", gzip.compress(utf8)), (b"deflate", zlib.compress(utf8)), (b"deflate", deflate.compress(utf8) + deflate.flush()), (b"zstd", zstandard.compress(utf8)), (b"deflate, gzip", gzip.compress(zlib.compress(utf8))), (b"identity", utf8)):
        assert converted(b"Content-Encoding: " + name, data)[0] == want, name
        chunks = b"".join(b"%x;a=b\r\n%s\r\n" % (len(data[i : i + 7]), data[i : i + 7]) for i in range(0, len(data), 7)) + b"0\r\n\r\n"
        assert converted(b"Transfer-Encoding: chunked\r\nContent-Encoding: " + name, chunks)[0] == want, name
    assert converted(b"Transfer-Encoding: chunked", utf8)[0] == want
    for head, fault in ((b"Content-Encoding: br", "br is not known"), (b"Content-Type: image/png", "image/png is not text")):
        text, meta = converted(head, b"\x89PNG")
        assert text == "" and f"{fault}\r\n" in meta
    assert converted(b"Content-Type: text/plain", b"a < b\n c")[0] == "a < b\n c"


def test_broken_files_give_rows_of_errors(spark, tmp_path):
    good = [warc.record(*warc.response(f"http://x/{i}", f"<p>t{i} WARC/1.1</p>", "2020-01-01T00:00:00Z")) for i in range(4)]
    cut = good[3][: len(good[3]) // 2]
    lost = b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n"
    odd = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n\r\n\r\n"
    made = {"a.warc": (good[0] + lost + good[1] + odd + good[2] + cut, 3, 3), "b.warc.gz": (b"".join(map(gzip.compress, good)), 4, 0), "c.warc.gz": (gzip.compress(b"".join(good))[:-40], None, None), "d.warc": (b"", 0, 0), "e.warc": (b"noise " * 400_000, 0, 1), "f.warc.zst": (b"".join(map(zstandard.compress, good)), 4, 0), "g.warc": (b"\r\n\r\n" + good[0] + b"\r\n" + good[1], 2, 0)}
    for name, (data, n, errors) in made.items():
        got = list(records(data))
        if n is not None:
            assert (sum(h is not None for h, _ in got), sum(h is None for h, _ in got)) == (n, errors), name
        (tmp_path / name).write_bytes(data)
    rows = derivatives_of_files(spark, str(tmp_path))
    got = rows.collect()
    texts = [r.block for r in got if r.warc_type == "conversion"]
    assert all(texts.count(f"t{i} WARC/1.1") >= n for i, n in ((0, 4), (1, 4), (2, 3), (3, 2)))
    assert sum(r.warc_type == "error" for r in got) >= 4 and all("byte" in r.block for r in got if r.warc_type == "error")
    assert warc.files(rows).count() == len(got) - sum(r.warc_type == "error" for r in got)


def test_a_long_record_and_a_dense_member():
    page = "<p>" + "word " * 3_000_000 + "</p>"
    made = warc.response("http://x", page, "2020-01-01T00:00:00Z")
    for data in (warc.record(*made), gzip.compress(warc.record(*made) * 2, 1)):
        got = list(records(data))
        assert got[0] == (made[0], made[1]) and len(got) == (1 if data[:2] == b"WA" else 2)
    assert max(map(len, warc.inflated(gzip.compress(bytes(50 << 20))))) <= warc.PART_BYTES

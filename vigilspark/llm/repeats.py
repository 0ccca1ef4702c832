"""Removal of repeated byte strings by suffix sorting with bucket-pointer refinement.

Every window of ``width`` bytes is anchored at its least q-gram (the leftmost of equals), so equal windows share an anchor and
their offset from it. A run is the windows of a document that share one anchor. Runs, not suffixes, are what is shuffled:

1. The initial buckets: runs by the q-gram at their anchor. Runs of equal bytes are one class, and all but its first
   occurrence repeat. Classes are collapsed in the task that reads the texts, then in the bucket.
2. Buckets that still hold several classes are refined: the bytes of each class's first occurrence are fetched, and their suffixes are
   sorted on bucket identifiers of later offsets, the identifiers of one depth being reused for the next, to depth ``width``.
   An anchor that one task alone meets in many classes isn't refined in one place: its windows are dealt out one by one.
3. Each document gets its repeated windows and loses the bytes under them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, Spans, carried, chunks, give_back, mix, own_columns, parts, runs, utf8

GRAM = 28
#: Runs that a task holds before it collapses and sends them.
HELD = 300_000
#: Classes of one anchor in one task from which on its windows are dealt out one by one.
HOT = 64
#: Classes of one anchor over all tasks up to which one task refines them.
WIDE = 1000
#: Bytes of text for which there is one bucket.
BUCKET_BYTES = 16_000_000
#: Bytes whose suffixes are sorted at once.
REFINED_BYTES = 1_000_000

_A, _K, _ID, _H, _START, _LEN, _FLAG = "u8", "u8", "i8", "u2", "u4", "u1", "u1"
RUN = (_A, _K, _ID, _H, _START, _LEN)
SPAN = (_ID, _H, _START, _LEN)
REQUEST = (_ID, _H, _START, _LEN, _A, _FLAG)
WINDOW = (_A, _ID, _H, _START)


def pack(arrays: list[np.ndarray], kinds: tuple[str, ...]) -> bytes:
    raw = struct.pack("<I", len(arrays[0])) + b"".join(np.ascontiguousarray(a, k).tobytes() for a, k in zip(arrays, kinds, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    got: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    d = zstandard.ZstdDecompressor()
    for b in blobs:
        b = d.decompress(b)
        n, at = struct.unpack_from("<I", b)[0], 4
        for out, k in zip(got, kinds, strict=True):
            out.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in got]


def _dealt(kind: int, bucket: np.ndarray, arrays: list[np.ndarray], kinds: tuple[str, ...]) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob) of the rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for i, j in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True) if len(bucket) else ():
        yield int(bucket[i]), kind, pack([a[i:j] for a in arrays], kinds)


def _rows(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.int32()), pa.array([x[2] for x in held], pa.binary())], ["bucket", "kind", "blob"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.int32()), pa.array([x[2] for x in held], pa.binary())], ["bucket", "kind", "blob"])
    give_back()


ROWS = "bucket int, kind int, blob binary"
RUNS, SPANS, REQUESTS, CONTEXTS, WINDOWS = range(5)
TEXT = 9


def doc_bucket(ids: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h) % np.uint64(n)).astype(np.int64)


def text_mark(b: bytes) -> int:
    """Tells rows apart that share an id."""
    return xxhash.xxh64_intdigest(b) & 0xFFFF


def anchored(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, row, start in the row, number of windows) of every run."""
    q, w = GRAM, width - GRAM + 1
    n = len(buf)
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    if n < width:
        return none
    spans = Spans(buf)
    g = spans.grams(q)
    bits = np.uint64(max(24, int(n).bit_length()))
    v = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while have * 2 <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < w:
        v = np.minimum(v[: len(v) - (w - have)], v[w - have :])
    length = np.diff(off)
    valid = np.zeros(n + 1, np.int32)
    long = length >= width
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[1:][long] - width + 1, -1)
    s = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(s):
        return none
    anchor = (v[s] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    many = np.diff(np.append(cut, len(s)))
    first = s[cut]
    row = np.searchsorted(off, first, "right") - 1
    return g[anchor[cut]], spans.of(first, first + many + width - 1), row, first - off[row], many


def _first_of(order_keys: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by group and keys, starts of groups in it, and the index of its group for each place."""
    order = np.lexsort([*reversed(order_keys), group])
    new = np.append(True, group[order][1:] != group[order][:-1]) if len(order) else np.zeros(0, bool)
    return order, new, np.cumsum(new) - 1


def _repeated(group: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each group and of those that are strictly later."""
    order, new, of = _first_of([ids, start], group)
    lead = order[new][of] if len(order) else order
    later = (ids[order] > ids[lead]) | ((ids[order] == ids[lead]) & (start[order] > start[lead]))
    return order[~later], order[later]


def _send_runs(width: int, buckets: int):
    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
        a, k, ids, h, start, many = (np.concatenate(x) for x in zip(*held, strict=True))
        keep, later = _repeated(k, ids, start)
        yield from _dealt(SPANS, doc_bucket(ids[later], h[later], buckets), [ids[later], h[later], start[later], many[later]], SPAN)
        a, k, ids, h, start, many = (x[keep] for x in (a, k, ids, h, start, many))
        _, of, count = np.unique(a, return_inverse=True, return_counts=True)
        hot = count[of] > HOT
        marked = np.unique(a[hot])
        zero = np.zeros(len(marked), np.int64)
        bucket = np.where(hot, mix(a ^ k), a) % np.uint64(buckets)
        a, k, ids, h, start, many, bucket = (np.concatenate(x) for x in ((a, marked), (k, marked), (ids, zero), (h, zero.astype(np.uint16)), (start, zero), (many | (hot * 128), zero), (bucket, marked % np.uint64(buckets))))
        yield from _dealt(RUNS, bucket, [a, k, ids, h, start, many], RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            held, n = [], 0
            for batch in batches:
                ids = batch.column(0).to_numpy()
                data, off = utf8(batch.column(1))
                for i, j in chunks(off):
                    own = off[i : j + 1] - off[i]
                    marks = np.array([text_mark(data[off[x] : off[x + 1]].tobytes()) for x in range(i, j)], np.uint16)
                    a, k, row, start, many = anchored(data[off[i] : off[j]], own, width)
                    held.append((a, k, ids[i:j][row], marks[row], start, many))
                    n += len(a)
                    if n > HELD:
                        yield from flush(held)
                        held, n = [], 0
            if held:
                yield from flush(held)

        yield from _rows(rows())

    return run


def _collapse(buckets: int):
    """Of each bucket of runs: repeated runs, and the first runs of classes whose anchor has several."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for t in runs(batches, ["bucket"]):
            kinds = t.column("kind").to_numpy()
            blobs = t.column("blob").to_pylist()
            for b in (b for k, b in zip(kinds, blobs, strict=True) if k == SPANS):
                yield t.column("bucket")[0].as_py(), SPANS, b
            a, k, ids, h, start, many = unpack([b for x, b in zip(kinds, blobs, strict=True) if x == RUNS], RUN)
            if not len(a):
                continue
            _, of, count = np.unique(a, return_inverse=True, return_counts=True)
            spread = (many & 128) > 0
            marks = many == 0
            told = np.zeros(len(count), bool)
            told[of[marks | spread]] = True
            at = np.flatnonzero((told[of] | (count[of] > 1)) & ~marks)
            of, told = of[at], told
            a, k, ids, h, start, many = (x[at] for x in (a, k, ids, h, start, many & 127))
            keep, later = _repeated(k, ids, start)
            yield from _dealt(SPANS, doc_bucket(ids[later], h[later], buckets), [ids[later], h[later], start[later], many[later]], SPAN)
            several = np.bincount(of[keep], minlength=len(told))
            hot = told | (several > WIDE)
            keep = keep[hot[of[keep]] | (several[of[keep]] > 1)]
            flag = hot[of[keep]].astype(np.uint8)
            yield from _dealt(REQUESTS, doc_bucket(ids[keep], h[keep], buckets), [ids[keep], h[keep], start[keep], many[keep], a[keep], flag], REQUEST)

    return lambda batches: _rows(rows(batches))


def _send_texts(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, 4 * 1024 * 1024):
                texts = [data[off[x] : off[x + 1]].tobytes() for x in range(i, j)]
                marks = np.array([text_mark(x) for x in texts], np.uint16)
                own = ids.slice(i, j - i)
                at = doc_bucket(own.fill_null(0).to_numpy(), marks, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([TEXT] * (j - i), pa.int32()), pa.array([squeeze.compress(x) for x in texts], pa.binary()), own, *(c.slice(i, j - i) for c in batch.columns[2:])], names=["bucket", "kind", "blob", "id", *batch.schema.names[2:]])

    return rows


def _with_texts(batches: Iterator[pa.RecordBatch], kind: int, kinds: tuple[str, ...]) -> Iterator[tuple[int | None, bytes, list[np.ndarray]]]:
    """Each text with its rows of the blobs that precede the texts of its bucket."""
    squeeze = zstandard.ZstdDecompressor()
    bucket, blobs, table = None, [], None
    for batch in batches:
        for b, k, blob, i in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
            if b != bucket:
                bucket, blobs, table = b, [], None
            if k == kind:
                blobs.append(blob)
            elif k == TEXT:
                if table is None:
                    table = unpack(blobs, kinds)
                    order = np.lexsort((table[1], table[0]))
                    table, blobs = [x[order] for x in table], []
                text = squeeze.decompress(blob)
                if i is None:
                    yield None, text, [x[:0] for x in table]
                    continue
                lo, hi = np.searchsorted(table[0], [i, i + 1]) if i < 2**63 - 1 else (np.searchsorted(table[0], i), len(table[0]))
                lo, hi = lo + np.searchsorted(table[1][lo:hi], [text_mark(text), text_mark(text) + 1]) if hi > lo else (lo, lo)
                yield i, text, [x[lo:hi] for x in table]


def _fetch(width: int, buckets: int):
    """The bytes of requested runs, or each of their windows on its own where the anchor is hot."""

    def flush_windows(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
        w, ids, h, start = (np.concatenate(x) for x in zip(*held, strict=True))
        keep, later = _repeated(w, ids, start)
        yield from _dealt(SPANS, doc_bucket(ids[later], h[later], buckets), [ids[later], h[later], start[later], np.ones(len(later))], SPAN)
        w, ids, h, start = (x[keep] for x in (w, ids, h, start))
        yield from _dealt(WINDOWS, w % np.uint64(buckets), [w, ids, h, start], WINDOW)

    def flush_runs(held: list[tuple[np.ndarray, ...]], texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        ids, h, start, many, a = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = a % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        for i, j in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            o = order[i:j]
            meta = pack([ids[o], h[o], start[o], many[o], a[o], np.zeros(len(o))], REQUEST)
            yield int(bucket[o[0]]), CONTEXTS, struct.pack("<I", len(meta)) + meta + zstandard.ZstdCompressor(level=1).compress(b"".join(texts[x] for x in o))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        cold, texts, hot, n_hot = [], [], [], 0
        for i, text, (ids, h, start, many, a, flag) in _with_texts(batches, REQUESTS, REQUEST):
            if not len(ids):
                continue
            is_hot = flag > 0
            if is_hot.any():
                spans = Spans(np.frombuffer(text, np.uint8))
                m = many[is_hot].astype(np.int64)
                at = np.repeat(start[is_hot].astype(np.int64), m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                hot.append((spans.of(at, at + width), np.full(len(at), i), np.full(len(at), h[0]), at))
                n_hot += len(at)
            x = ~is_hot
            if x.any():
                cold.append((ids[x], h[x], start[x], many[x], a[x]))
                texts += [text[s : s + m + width - 1] for s, m in zip(start[x].tolist(), many[x].tolist(), strict=True)]
            if len(texts) > 100_000:
                yield from flush_runs(cold, texts)
                cold, texts = [], []
            if n_hot > HELD:
                yield from flush_windows(hot)
                hot, n_hot = [], 0
        if texts:
            yield from flush_runs(cold, texts)
        if hot:
            yield from flush_windows(hot)

    return lambda batches: _rows(rows(batches))


def _identifiers(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers: equal for equal keys."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    k = keys[order]
    out[order] = np.cumsum(np.append(True, k[1:] != k[:-1])) if len(k) else k
    return out


def refined(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Identifiers of the strings of ``width`` bytes at some offsets, by refining buckets of short strings on identifiers of later offsets."""
    depth = width // 4
    ids = _identifiers(Spans(buf).grams(depth))
    while depth * 2 < width:
        pairs = ids[:-depth] * (ids.max() + 1) + ids[depth:]
        ids, depth = _identifiers(pairs), depth * 2
    return _identifiers(ids[at] * (ids.max() + 1) + ids[at + width - depth])


def _refine(width: int, buckets: int):
    def refine(tables: list[list[np.ndarray]], texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        ids, h, start, many, _, _ = (np.concatenate(x) for x in zip(*tables, strict=True))
        m = many.astype(np.int64)
        length = m + width - 1
        base = np.cumsum(length) - length
        of = np.repeat(np.arange(len(m)), m)
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        group = refined(np.frombuffer(b"".join(texts), np.uint8), base[of] + step, width)
        wid, wst, wh = ids[of], start[of].astype(np.int64) + step, h[of]
        shared = np.bincount(group)[group] > 1
        group, wid, wst, wh = group[shared], wid[shared], wst[shared], wh[shared]
        _, later = _repeated(group, wid, wst)
        yield from _dealt(SPANS, doc_bucket(wid[later], wh[later], buckets), [wid[later], wh[later], wst[later], np.ones(len(later))], SPAN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for t in runs(batches, ["bucket"]):
            kinds, blobs = t.column("kind").to_numpy(), t.column("blob").to_pylist()
            bucket = t.column("bucket")[0].as_py()
            for b in (b for k, b in zip(kinds, blobs, strict=True) if k == SPANS):
                yield bucket, SPANS, b
            w, ids, h, start = unpack([b for k, b in zip(kinds, blobs, strict=True) if k == WINDOWS], WINDOW)
            if len(w):
                _, later = _repeated(w, ids, start)
                yield from _dealt(SPANS, doc_bucket(ids[later], h[later], buckets), [ids[later], h[later], start[later], np.ones(len(later))], SPAN)
            contexts = [b for k, b in zip(kinds, blobs, strict=True) if k == CONTEXTS]
            if not contexts:
                continue
            tables, raw = [], []
            for b in contexts:
                n = struct.unpack_from("<I", b)[0]
                tables.append(unpack([b[4 : 4 + n]], REQUEST))
                raw.append(zstandard.ZstdDecompressor().decompress(b[4 + n :]))
            table = [np.concatenate(x) for x in zip(*tables, strict=True)]
            length = table[3].astype(np.int64) + width - 1
            ends = np.cumsum(length)
            whole = b"".join(raw)
            order = np.argsort(table[4], kind="stable")
            # whole anchors at a time, so that their windows meet
            a = table[4][order]
            new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            size = np.add.reduceat(length[order], new)
            held, n = [], 0
            for x, y, s in zip(new, np.append(new[1:], len(order)), size, strict=True):
                held.append(order[x:y])
                n += s
                if n > REFINED_BYTES:
                    o = np.concatenate(held)
                    yield from refine([[c[o] for c in table]], [whole[ends[k] - length[k] : ends[k]] for k in o])
                    held, n = [], 0
            if held:
                o = np.concatenate(held)
                yield from refine([[c[o] for c in table]], [whole[ends[k] - length[k] : ends[k]] for k in o])

    return lambda batches: _rows(rows(batches))


def covered(n: int, start: np.ndarray, many: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs of bytes."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    s = start[order].astype(np.int64)
    e = np.maximum.accumulate(s + many[order].astype(np.int64) + width - 1)
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(new[1:], True)]


def _cut_texts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "mark", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        held: list[tuple] = []
        for i, text, (_, _, start, many) in _with_texts(batches, SPANS, SPAN):
            s, e = covered(len(text), start, many, width)
            kept = hashlib.sha256()
            at = 0
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            held.append((i, text_mark(text), len(text), int((e - s).sum()), len(s), kept.hexdigest(), s, e))
            if len(held) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return run


def _cut_whole(width: int):
    """As _cut_texts, but what is left of the text itself; characters cut in part go too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.flatnonzero(batch.column(1).to_numpy() == TEXT)
                rest.extend(batch.take(pa.array(own[i : i + 500])) for i in range(0, len(own), 500))
                yield batch

        held: list[tuple] = []
        for _, text, (_, _, start, many) in _with_texts(noted(), SPANS, SPAN):
            s, e = covered(len(text), start, many, width)
            at, left = 0, []
            for x, y in zip([*s.tolist(), len(text)], [*e.tolist(), len(text)], strict=True):
                left.append(text[at:x])
                at = y
            held.append((len(s), "".join(x.decode("utf-8", "ignore") for x in left)))
            if len(held) == rest[0].num_rows:
                of = rest.pop(0)
                yield pa.RecordBatch.from_arrays([of.column(3), pa.array([x for x, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string()), *of.columns[4:]], names=["id", "n_spans", "text", *of.schema.names[4:]])
                held = []

    return run


def repeated_bytes(docs: DataFrame, *, width: int = 100, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: id, mark, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (maximal removed runs, as byte offsets).

    Removed is each byte under a string of ``width`` bytes that also starts earlier: in a smaller id, or in the same document
    further left. Texts are UTF-8 bytes; matches don't cross documents; all strings are judged on the input.

    With ``texts`` the rows are id, n_spans and text (what is left; a character of which a part is removed goes), then the columns named in carry.
    Of id and n_spans those are left out whose names are carried.
    Null texts are empty. A text shorter than ``width`` is kept whole. Rows of one id with different texts are told apart by mark,
    and neither is earlier than the other at the same offset; repeated rows likewise. A row without an id is compared with nothing and kept whole.
    Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "repeats")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parts(spark), -(-int(size) // BUCKET_BYTES))
    sent = rows.where("id is not null").mapInArrow(_send_runs(width, n), ROWS)
    met = lambda df: df.repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind")
    first = scratch.cut(met(sent).mapInArrow(_collapse(n), ROWS), "classes")
    src, schema, back = carried(docs, id_col, text_col, [c for c in carry or [] if c != text_col])
    schema = schema.replace(", __t string", "", 1)
    own = (src if texts else rows).mapInArrow(_send_texts(n), ROWS + ", id long" + schema * texts)
    apart = lambda df: df.select("bucket", "kind", "blob", *[F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema.fields[3:]])
    fetched = met(own.where("id is not null").unionByName(apart(first.where(f"kind = {REQUESTS}")))).mapInArrow(_fetch(width, n), ROWS)
    second = scratch.cut(met(fetched).mapInArrow(_refine(width, n), ROWS), "refined")
    spans = first.where(f"kind = {SPANS}").unionByName(second)
    joined = met(own.unionByName(apart(spans)))
    if texts:
        return joined.mapInArrow(_cut_whole(width), "id long, n_spans long, text string" + schema).select(*own_columns(["id", "n_spans"], carry), F.col("text").alias(text_col), *back)
    return joined.mapInArrow(_cut_texts(width), "id long, mark int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")

"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, one scan of the documents, verified hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import _R, _R_INV, ALNUM_WORD, LOWER, _powers, carried, chunks, mix, own_columns, utf8, word_hashes, words

#: Bytes of benchmark text in one broadcast block, whose index takes about eight times as many; a larger benchmark is scanned for block by block.
BLOCK_BYTES = 8_000_000
_SIEVE = 1 << 22


def _window_hashes(word_hashes: np.ndarray, length: int) -> np.ndarray:
    n = len(word_hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * _powers(_R, n), out=p[1:])
    return mix((p[length:] - p[:-length]) * _powers(_R_INV, n + 1)[: n - length + 1] + np.uint64(length))


def _word_lists(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf = LOWER[data[off[0] : off[-1]]]
    s, e, at = words(buf, off - off[0], ALNUM_WORD)
    return buf, s, e, at, word_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)


def window_index(items: list[tuple[str | None, str | None]], width: int) -> dict:
    """The windows of a block of items, in arrays: by length, their sorted hashes, a first word for each and its items; beside them the text and its words."""
    texts = pa.array([t for _, t in items], pa.string())
    buf, s, e, at, h = _word_lists(*utf8(texts))
    size = np.minimum(width, np.diff(at))
    out = {"ids": [i for i, _ in items], "text": buf.tobytes(), "starts": s.astype(np.int32), "ends": e.astype(np.int32), "lengths": []}
    for length in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == length)
        # an item's windows, or the whole of a short one
        first = np.concatenate([np.arange(at[k], at[k + 1] - length + 1) for k in own])
        item = np.repeat(own, at[own + 1] - at[own] - length + 1)
        w = _window_hashes(h, length)[first]
        order = np.lexsort((item, w))
        w, item, first = w[order], item[order], first[order]
        keep = np.append(True, (w[1:] != w[:-1]) | (item[1:] != item[:-1]))
        w, item, first = w[keep], item[keep], first[keep]
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        sieve = np.zeros(_SIEVE, bool)
        sieve[(w % np.uint64(_SIEVE)).astype(np.int64)] = True
        out["lengths"].append((length, w[new], np.packbits(sieve), first[new].astype(np.int32), item.astype(np.int32), np.append(new, len(w)).astype(np.int32)))
    return out


def _scan(width: int, blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def index(block):
            raw = block.value if len(blocks) == 1 else block.load_from_path(block._path)
            return raw, [(n, hs, np.unpackbits(bits).view(bool), *rest) for n, hs, bits, *rest in raw["lengths"]]

        only = index(blocks[0]) if len(blocks) == 1 else None
        for batch in batches:
            data, off = utf8(batch.column(1))
            # with several blocks each is loaded once for a whole batch of texts
            for i, j in chunks(off, (1 << 20) if len(blocks) == 1 else (1 << 23)):
                own = off[i : j + 1]
                buf, s, e, at, h = _word_lists(data, own)
                marks = np.zeros(len(s) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(j - i)]
                row_of = np.repeat(np.arange(j - i), np.diff(at))
                for block in blocks:
                    known, lengths = only or index(block)
                    ids, text, ks, ke = known["ids"], known["text"], known["starts"], known["ends"]
                    for length, hashes, sieve, firsts, owners, cuts in lengths:
                        w = _window_hashes(h, length)
                        # windows across a boundary of documents don't count
                        may = np.flatnonzero(sieve[(w % np.uint64(_SIEVE)).astype(np.int64)])
                        may = may[row_of[may] == row_of[may + length - 1]]
                        place = np.searchsorted(hashes, w[may])
                        place[place == len(hashes)] = 0
                        equal = hashes[place] == w[may]
                        for p, k in zip(may[equal].tolist(), place[equal].tolist(), strict=True):
                            f = int(firsts[k])
                            places = zip(s[p : p + length].tolist(), e[p : p + length].tolist(), ks[f : f + length].tolist(), ke[f : f + length].tolist(), strict=True)
                            if all(buf[x:y].tobytes() == text[a:b] for x, y, a, b in places):
                                marks[p] += 1
                                marks[p + length] -= 1
                                items[row_of[p]].update(ids[o] for o in owners[cuts[k] : cuts[k + 1]].tolist() if ids[o] is not None)
                hit = np.cumsum(marks[:-1]) > 0
                total = np.append(0, np.cumsum(hit))
                first, last = hit.copy(), hit.copy()
                if len(hit):
                    edge = at[:-1][at[1:] > at[:-1]]
                    first[1:] &= ~hit[:-1]
                    first[edge] = hit[edge]
                    last[:-1] &= ~hit[1:]
                    edge = at[1:][at[1:] > at[:-1]] - 1
                    last[edge] = hit[edge]
                fs, ls = np.flatnonzero(first), np.flatnonzero(last)
                cut = np.searchsorted(fs, at)
                base = own[:-1] - own[0]
                starts = [(s[fs[x:y]] - b).tolist() for x, y, b in zip(cut[:-1], cut[1:], base, strict=True)]
                ends = [(e[ls[x:y]] - b).tolist() for x, y, b in zip(cut[:-1], cut[1:], base, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), *(c.slice(i, j - i) for c in batch.columns[1:])],
                    names=["id", "n_words", "n_hit", "items", "starts", "ends", *batch.schema.names[1:]],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None, keep: str = "true") -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids, as strings, of items with windows in it), starts and ends (byte offsets of hit runs of words), then the columns named in carry.
    Of our columns those are left out whose names are carried. keep is a condition on our columns; other rows go.

    Words are runs of digits, letters and non-ASCII characters, lower-cased (A-Z). An item's windows are all of its ``width``
    consecutive words, or the whole of a shorter item. A document's word inside any occurrence of a window is hit.

    The benchmark is collected and broadcast in blocks of BLOCK_BYTES of its text (one item at least), so no broadcast
    grows with it; documents are read once and never shuffled. Each hash hit is verified on its words.

    Null texts have no words. Items without an id hit but aren't listed; items of one id count once. Repeated rows give a
    row each, as do rows without an id.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = benchmark.select(F.col(item_id_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    blocks = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        blocks.append(spark.sparkContext.broadcast(window_index([(r.i, r.t) for r in part.toLocalIterator()], width)))
    src, schema, back = carried(docs, id_col, text_col, carry or [])
    out = src.mapInArrow(_scan(width, blocks), "id long, n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>" + schema)
    return out.where(keep).select(*own_columns(["id", "n_words", "n_hit", "items", "starts", "ends"], carry), *back)


#: A document with a hit whose hit words are a twentieth of its words at least.
CONTAMINATED = "(n_hit > 0 AND 20 * n_hit >= n_words)"

"""Best-fit packing of tokenised documents by a configuration linear program.

The lengths' histogram, at most ``capacity`` numbers however many documents there are, is all that the driver plans from. A
configuration is a multiset of lengths that fits in one sequence. The program (fewest configurations that cover the
histogram) is solved by multiplicative weights: a knapsack dynamic program prices configurations by the weights of what they
hold, those of most weight are taken for a part of what they cover, and the weights of what is covered fall. Steps are rounded to whole sequences as
they are taken, so that nothing of a configuration is lost. What only fits configurations that leave much room is packed best fit, longest first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, Scratch, chunks, give_back, parts, remembered, utf8

CAPACITY = 4096
#: Rounds of multiplicative weights (one dynamic program each), the part of all items that a round places, and the step of a configuration as a part of its
#: scarcest length.
ROUNDS, PART, STEP = 60, 0.08, 0.5
#: Ways in which the program is solved, of whose plans the one of fewest sequences is taken: how fast weights fall, the least part of a sequence that a
#: configuration fills (what fits none is packed best fit), the part of the items that is kept back for best fit, differences of worth that don't
#: count, and whether the longest (or else the shortest) of equal worth is taken.
WAYS = [(0.01, 0.995, 0.06, 3e-3, True), (0.003, 0.995, 0.09, 1e-3, True), (0.5, 0.985, 0.06, 1e-9, False)]
#: Distinct chunks between white space whose ids a worker remembers.
REMEMBERED = 800_000
#: Marks before which the tokenizer always cuts a word; a space there changes nothing.
_MARK = np.zeros(256, bool)
_MARK[[33, 44, 46, 58, 59, 63]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


# ---------------------------------------------------------------- tokens
#: One or more letters of ASCII or of U+00C0 to U+00FF.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


#: Stands between texts; no UTF-8 text has this byte.
_END = b"\xff"


def loosened(data: np.ndarray, ends: np.ndarray) -> bytes:
    """The texts, lower-cased (A-Z), with a space between a letter and a mark after it and a chunk _END after each text: fewer distinct chunks, the same ids."""
    letter = _LETTER[data]
    # the letters of U+00C0 to U+00FF, but for the signs of multiplication and division
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    at = np.flatnonzero(_MARK[data[1:]] & letter[:-1]) + 1
    between = np.repeat(ends, 3)
    return np.insert(LOWER[data], np.append(at, between), np.append(np.full(len(at), 32, np.uint8), np.tile(np.array([32, 255, 32], np.uint8), len(ends)))).tobytes()


class ChunkTokens:
    """Ids of texts, by those of their chunks between ASCII white space; right for tokenizers that drop white space and never reach across it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 14, np.int64)
        self.n = 0

    def ids_of(self, new: list[bytes]) -> list[np.ndarray]:
        """The ids of each chunk. Chunks of letters alone are encoded many at a time: each is one word, of which only the last id ends one."""
        out: list[np.ndarray] = [None] * len(new)
        plain = [i for i, b in enumerate(new) if _LETTERS.fullmatch(b)]
        for x in range(0, len(plain), 2000):
            own = plain[x : x + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join([new[i] for i in own]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                for i, a, b in zip(own, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, o in enumerate(out) if o is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([new[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def learn(self, new: list[bytes]) -> None:
        got = self.ids_of(new)
        ends = self.off[self.n] + np.cumsum([len(x) for x in got])
        while ends[-1] + 1 > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        while self.n + len(new) + 2 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros(len(self.off), np.int64)])
        self.flat[self.off[self.n] : ends[-1]] = np.concatenate(got)
        self.off[self.n + 1 : self.n + 1 + len(new)] = ends
        self.at.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.n += len(new)

    def __call__(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end`` after it, and the offsets of the texts."""
        if self.n > REMEMBERED:
            self.reset()
        raw = data.tobytes()
        if b"<|" in raw:
            # special tokens are told by their case, so texts that may hold some stay as they are
            parts_ = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            raw = b"".join(t + b" \xff " if b"<|" in t or len(t) < 2 else loosened(np.frombuffer(t, np.uint8), np.array([len(t)])) for t in parts_)
        else:
            raw = loosened(data, off[1:]) if len(data) > 1 else data.tobytes() + b" \xff " * (len(off) - 1)
        flat = raw.split()
        k = list(map(self.at.get, flat))
        if None in k:
            missed = [i for i, x in enumerate(k) if x is None]
            new = dict.fromkeys(flat[i] for i in missed)
            new.pop(_END, None)
            new = list(new)
            for i in range(0, len(new), 20_000):
                self.learn(new[i : i + 20_000])
            if _END not in self.at:
                self.at[_END] = self.n
                self.flat[self.off[self.n]] = end
                self.off[self.n + 1] = self.off[self.n] + 1
                self.n += 1
            for i in missed:
                k[i] = self.at[flat[i]]
        k = np.array(k, np.int64)
        n = self.off[k + 1] - self.off[k]
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.off[k] - (ends - n), n) + np.arange(ends[-1])]
        return out, np.append(0, ends[k == self.at[_END]])


_tokens: dict[str, ChunkTokens] = {}
remembered["packing"] = _tokens.clear


def _tokens_of(path: str) -> ChunkTokens:
    """One for each worker, which keeps what it has learned from task to task."""
    if path not in _tokens:
        _tokens[path] = ChunkTokens(path)
    return _tokens[path]


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens_of(path)
        for batch in batches:
            ids_col = batch.column(0)
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, 1 << 20):
                ids, at = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], end)
                row, piece, start, length, crc = [], [], [], [], []
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for k, x in enumerate(range(a, b, capacity)):
                        y = min(b, x + capacity)
                        row.append(i + r), piece.append(k), start.append(x - a), length.append(y - x)
                        crc.append(zlib.crc32(ids[x:y].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([ids_col.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "crc"])
        give_back("packing")

    return run


# ---------------------------------------------------------------- the plan


def priced(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest value of a multiset of lengths that fits in each room from 0 to capacity, by dynamic programming."""
    order = np.argsort(lengths)
    ls, vs = lengths[order], values[order]
    best = np.zeros(capacity + 1)
    fit = np.searchsorted(ls, np.arange(capacity + 1), "right")
    for c in range(int(ls[0]), capacity + 1):
        best[c] = max(best[c - 1], (best[c - ls[: fit[c]]] + vs[: fit[c]]).max())
    return best


def filled(first: int, lengths: np.ndarray, left: np.ndarray, values: np.ndarray, best: np.ndarray, capacity: int, tie: float, longest: bool) -> dict[int, int]:
    """The configuration that holds one length and is filled by what is worth most with the room that it leaves, of what is left."""
    out, room = {first: 1}, capacity - int(lengths[first])
    has = left > 0
    has[first] = left[first] > 1
    while True:
        fits = np.flatnonzero(has[: np.searchsorted(lengths, room, "right")])
        if not len(fits):
            return out
        worth = values[fits] + best[room - lengths[fits]]
        i = int(fits[np.flatnonzero(worth >= worth.max() - tie)[-1 if longest else 0]])
        out[i] = out.get(i, 0) + 1
        room -= int(lengths[i])
        has[i] = left[i] > out[i]


def solved(lengths: np.ndarray, counts: np.ndarray, capacity: int, way: tuple[float, float, float, float, bool] = WAYS[0]) -> tuple[list[tuple[int, list[tuple[int, int]]]], np.ndarray, float]:
    """The program's configurations with the times that each is taken, what they leave of each length, and a lower bound of the number of sequences.

    lengths ascend. Weights begin as parts of the capacity. The bound is that of weak duality: the weight of all items over the greatest weight of a configuration.
    """
    rate, full, part, tie, longest = way
    # of every length a part is kept back, spread over lengths that few items have, so that the rest holds what fills gaps
    spread = (np.arange(1, len(lengths) + 1) * 0.6180339887498949) % 1
    kept = np.minimum(counts, (part * counts + spread).astype(np.int64))
    left, plan, bound = counts - kept, [], 0.0
    values = lengths / capacity
    hopeless = np.zeros(len(lengths), bool)
    for _ in range(ROUNDS):
        open_ = np.flatnonzero((left > 0) & ~hopeless)
        if not len(open_):
            break
        best = priced(lengths[left > 0], values[left > 0], capacity)
        bound = max(bound, float((counts * values).sum() / priced(lengths, values, capacity)[capacity])) if not plan else bound
        goal, placed = max(PART * float((left * lengths).sum()), capacity), 0
        # lengths whose best configuration is worth most per round, the longest first among equals
        seeds = open_[np.lexsort((-lengths[open_], -np.round(values[open_] + best[capacity - lengths[open_]], 6)))]
        for i in seeds:
            while left[i] > 0 and placed < goal:
                config = filled(int(i), lengths, left, values, best, capacity, tie, longest)
                k, n = np.array(sorted(config.items())).T
                if (lengths[k] * n).sum() < full * capacity:
                    hopeless[i] = True
                    break
                most = int((left[k] // n).min())
                times = max(1, int(most * STEP))
                plan.append((times, [(int(lengths[a]), int(b)) for a, b in zip(k, n, strict=True)]))
                left[k] -= times * n
                values[k] = lengths[k] / capacity * np.exp(rate * (left[k] / counts[k] - 1))
                placed += times * int((lengths[k] * n).sum())
                if times < most:
                    break
            if placed >= goal:
                break
    return plan, left + kept, bound


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, times in it)]) that hold every item of the histogram exactly once: the program's plan and best fit for its rest, or best fit alone where that takes fewer."""
    order = np.argsort(lengths)
    lengths, left = lengths[order], counts[order].astype(np.int64)
    whole = lengths == capacity
    plan = [(int(left[whole][0]), [(capacity, 1)])] if whole.any() else []
    lengths, left = lengths[~whole], left[~whole]
    if not len(lengths):
        return plan
    plans = []
    for way in WAYS:
        own, rest, _ = solved(lengths, left, capacity, way)
        own += best_fit(lengths, rest, capacity)
        plans.append((sum(n for n, _ in own), int((rest * lengths).sum()), own))
    few = min(plans, key=lambda p: p[:2])
    plain = best_fit(lengths, left, capacity)
    return plan + (few[2] if few[0] <= sum(n for n, _ in plain) else plain)


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, over groups of sequences that hold the same."""
    room: dict[int, list[tuple[int, list]]] = {}
    free = np.zeros(capacity + 1, bool)
    for at in np.argsort(-lengths):
        size, n = int(lengths[at]), int(counts[at])
        while n:
            r = int(np.argmax(free[size:])) + size
            if not free[r]:
                k = capacity // size
                for m, each in ((n // k, k), (1, n % k)) if n % k else ((n // k, k),):
                    if m:
                        room.setdefault(capacity - each * size, []).append((m, [(size, each)]))
                        free[capacity - each * size] = True
                break
            m, config = room[r].pop()
            if not room[r]:
                free[r] = False
            k = r // size
            full = min(m, n // k)
            rest = []
            if full:
                rest.append((full, [*config, (size, k)], r - k * size))
                n -= full * k
                m -= full
            if m and n and n < k:
                rest.append((1, [*config, (size, n)], r - n * size))
                n, m = 0, m - 1
            if m:
                rest.append((m, config, r))
            for times, c, left in rest:
                room.setdefault(left, []).append((times, c))
                free[left] = True
    return [(m, c) for groups in room.values() for m, c in groups]


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Of each length, runs of its items' ranks: the first rank, the first sequence, how many in each, the offset of the first."""
    rows, sequence, used = [], 0, {}
    for times, config in plan:
        at = 0
        for length, n in config:
            rows.append((length, used.get(length, 0), sequence, n, at))
            used[length] = used.get(length, 0) + times * n
            at += length * n
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), a.T.copy(), strict=True))


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = plan.value
        key = s["length"] << 44 | s["first"]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            k = np.searchsorted(key, length << 44 | rank, "right") - 1
            r = rank - s["first"][k]
            sequence = s["sequence"][k] + r // s["each"][k]
            offset = s["offset"][k] + r % s["each"][k] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "piece", "start", "length", "crc")), pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "crc", "sequence", "offset"])

    return run


def packed(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then end_id; longer ones than capacity are cut into pieces of it, the last one shorter. Pieces lie in
    sequences of capacity at most, one after another from 0. Null texts are empty: end_id alone. Repeated rows and rows
    without an id are packed each on its own. An empty table gives no rows. Other columns of docs are ignored.

    Items of one length are ranked within buckets of documents, and each bucket gets its first rank, so no length is gathered in a task.
    The driver sees the histogram only; the plan that is broadcast has as many rows as lengths in configurations, which the capacity
    and the number of rounds bound.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = scratch.cut(rows.mapInArrow(_pieces(tokenizer, end_id, capacity), "id long, piece int, start long, length long, crc long"), "pieces")
    buckets = 8 * parts(spark)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = configurations(np.array([r.length for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), capacity)
    shared = spark.sparkContext.broadcast(slots(plan))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")))
    ranked = own.join(firsts, ["length", "bucket"]).select("id", "piece", "start", "length", "crc", (F.col("first") + F.col("r") - 1).cast("long").alias("rank"))
    out = ranked.mapInArrow(_place(shared), "id long, piece int, start long, length long, crc long, sequence long, offset long")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")

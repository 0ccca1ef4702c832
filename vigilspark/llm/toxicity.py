"""Toxicity by nearest labelled examples: exact TF-IDF cosine from a block-max inverted index, distance-weighted calibrated votes.

A bounded sample of labelled training rows gives the examples; all their words are terms. A term weighs its inverse document
frequency, counted over all documents, times the power RELEVANCE of how surely its shares of the two classes' examples differ (FLOOR at
least, so that no known word weighs nothing). The index keeps, for each term, its postings by block of examples and the greatest
weight in each block; a search visits blocks in the order of their upper bounds and ends when no bound exceeds the k-th best
cosine, so its neighbours are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM_WORD, LOWER, Scratch, carried, chunks, give_back, own_columns, settle, utf8, word_hashes, words

#: Examples of each class at most (a sample of the labelled training rows, by hash), and distinct words of all of them together.
EXAMPLES, EXAMPLE_TERMS = 2500, 4_000_000
RELEVANCE, FLOOR = 2.0, 0.05
#: Neighbours that vote, examples in a block, blocks that a search visits before it looks at bounds again.
NEIGHBOURS, BLOCK, FIRST = 15, 16, 6
#: Terms whose postings are dense, queries that are multiplied by them at once, and more than single precision takes from a sum of at most 1.
COMMON, QUERIES, SLACK = 1024, 128, 1e-5
#: Scores of equal lists of terms that a task remembers.
REMEMBERED = 20_000


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the row of each."""
    buf = LOWER[buf]
    s, e, at = words(buf, off, ALNUM_WORD)
    return word_hashes(buf, s, e), np.repeat(np.arange(len(off) - 1), np.diff(at))


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each row and their counts."""
    give_back()
    for batch in batches:
        data, off = utf8(batch.column(2))
        for i, j in chunks(off):
            h, row = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
            cut = np.searchsorted(row, np.arange(j - i + 1))
            t, c, m = [], [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                u, n = np.unique(h[a:b], return_counts=True)
                t.append(u.tobytes()), c.append(n.astype(np.int64).tobytes()), m.append(len(u))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(m, pa.int64()), pa.array(t, pa.binary()), pa.array(c, pa.binary())], ["id", "label", "m", "terms", "counts"])


def counted(vocabulary: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the words in a sorted vocabulary, by row and term."""
    h, row = terms(buf, off)
    if not len(vocabulary) or not len(h):
        return (np.zeros(0, np.int64),) * 3
    distinct, which = np.unique(h, return_inverse=True)
    k = np.searchsorted(vocabulary, distinct)
    k[k == len(vocabulary)] = 0
    known = vocabulary[k] == distinct
    on = known[which]
    key, n = np.unique(row[on] * len(vocabulary) + k[which[on]], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n


def relevance(holders: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """Of each term, from its numbers of examples of class 0 and 1: the log ratio of the smoothed shares over its standard error, to the power RELEVANCE."""
    if not min(sizes):
        return np.ones(len(holders))
    a, b = holders[:, 1] + 0.5, holders[:, 0] + 0.5
    lift = np.log(a / (sizes[1] + 1)) - np.log(b / (sizes[0] + 1))
    return np.maximum(np.abs(lift) / np.sqrt(1 / a + 1 / b), FLOOR) ** RELEVANCE


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class BlockMax:
    """An inverted index by blocks of examples.

    Postings of the COMMON terms that most examples hold are a dense matrix, which a batch of queries is multiplied by at once; the others' are lists by
    block, each with its greatest weight. A block's bound is the greatest sum of common terms in it and the greatest weights of the others; only blocks whose bounds
    reach the k-th best cosine so far are looked into. What may be among the nearest gets its whole cosine in double precision.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, n_terms: int):
        # examples of like heaviest terms lie together, so that blocks differ
        order = sorted(range(len(rows)), key=lambda i: (int(rows[i][0][np.argmax(rows[i][1])]) if len(rows[i][0]) else -1, labels[i]))
        self.order, self.labels, self.ids = np.array(order, np.int64), labels[order], [ids[i] for i in order]
        self.size = np.array([len(rows[i][0]) for i in order], np.int64)
        #: the terms and weights of all examples, one after another
        self.own_term = (np.concatenate([rows[i][0] for i in order]) if order else np.zeros(0, np.int64)).astype(np.int32)
        self.own_weight = np.concatenate([rows[i][1] for i in order]) if order else np.zeros(0)
        self.n_terms = n_terms
        self.build()

    def __getstate__(self) -> dict:
        """Only the examples' own lists are sent; the index is built where it is read."""
        return {x: getattr(self, x) for x in ("order", "labels", "ids", "size", "own_term", "own_weight", "n_terms")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.build()

    def build(self) -> None:
        n_terms = self.n_terms
        self.n, self.blocks = len(self.size), -(-len(self.size) // BLOCK)
        self.own = np.cumsum(self.size) - self.size
        example = np.repeat(np.arange(self.n), self.size)
        many = np.bincount(self.own_term, minlength=n_terms)
        common = np.argsort(-many, kind="stable")[:COMMON]
        self.place = np.full(n_terms, -1, np.int32)
        self.place[common] = np.arange(len(common))
        at = self.place[self.own_term]
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.dense[at[at >= 0], example[at >= 0]] = self.own_weight[at >= 0]
        term, example, weight = self.own_term[at < 0], example[at < 0], self.own_weight[at < 0]
        by = np.lexsort((example, term))
        term, example, self.weight = term[by], example[by], weight[by]
        block = example // BLOCK
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.example = example.astype(np.int32)
        #: of each pair of a term and a block: the block, the greatest weight and where its postings begin; of each term: where its pairs begin
        self.block, self.most = block[first].astype(np.int32), np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.start, self.pairs = np.append(first, len(term)), np.searchsorted(term[first], np.arange(n_terms + 1))
        self.query = np.zeros(n_terms)

    def exact(self, examples: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The cosines of a query with some examples, from their own lists of terms."""
        self.query[term] = weight
        n = self.size[examples]
        at = _ranges(self.own[examples], n)
        out = np.bincount(np.repeat(np.arange(len(examples)), n), self.query[self.own_term[at]] * self.own_weight[at], minlength=len(examples))
        self.query[term] = 0
        return out

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms and weights) the k examples of greatest cosine above 0, and the cosines; ties by position."""
        out = []
        for i in range(0, len(queries), QUERIES):
            some = queries[i : i + QUERIES]
            q = np.zeros((len(some), len(self.dense)), np.float32)
            for r, (term, weight) in enumerate(some):
                at = self.place[term]
                q[r, at[at >= 0]] = weight[at >= 0]
            sums = q @ self.dense
            most = sums.reshape(len(some), self.blocks, BLOCK).max(2)
            for r, (term, weight) in enumerate(some):
                rare = self.place[term] < 0
                out.append(self._nearest(term, weight, sums[r], most[r], term[rare], weight[rare], k, without[i + r] if without else -1))
        return out

    def _nearest(self, term: np.ndarray, weight: np.ndarray, sums: np.ndarray, most: np.ndarray, rare: np.ndarray, rare_weight: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.pairs[rare + 1] - self.pairs[rare]
        pair, w = _ranges(self.pairs[rare], n), np.repeat(rare_weight, n)
        block = self.block[pair]
        bound = most + np.bincount(block, w * self.most[pair], minlength=self.blocks) + SLACK

        def looked_into(visited: np.ndarray) -> np.ndarray:
            on = np.flatnonzero(visited[block])
            own = pair[on]
            start = self.start[own]
            many = self.start[own + 1] - start
            post = _ranges(start, many)
            found = np.repeat(visited, BLOCK)[: self.n] * sums[: self.n]
            found += np.bincount(self.example[post], np.repeat(w[on], many) * self.weight[post], minlength=self.n)
            if without >= 0:
                found[without] = 0
            return found

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[:FIRST]] = True
        score = looked_into(first)
        least = np.partition(score, -k)[-k] - 2 * SLACK if self.n > k else 0.0
        rest = (bound >= least) & ~first
        if rest.any():
            score += looked_into(rest)
        least = max(np.partition(score, -k)[-k] - 2 * SLACK, 0.0) if self.n > k else 0.0
        found = np.flatnonzero((score >= least) & (score > 0))
        cosine = self.exact(found, term, weight)
        best = np.lexsort((found, -cosine))[:k]
        return found[best], cosine[best]


class Model:
    """Terms with their weights, the index of the examples and what makes votes of neighbours a score."""

    def __init__(self, vocabulary: np.ndarray, importance: np.ndarray, rows: list, labels: np.ndarray, ids: list, totals: tuple[int, int]):
        self.hashes, self.importance = vocabulary, importance
        self.index = BlockMax([self.weighted(t, n) for t, n in rows], labels, ids, len(vocabulary))
        n1 = int((labels == 1).sum())
        n0 = len(labels) - n1
        self.prior = totals[1] / max(1, sum(totals))
        self.slope, self.base, self.alone = 0.0, -20.0 if not n1 else 20.0, self.prior
        if not n0 or not n1:
            return
        # each example is judged by the others; classes count as they do among all labelled training rows
        votes = [v for v, _ in self.votes([self.weighted(*r) for r in rows], np.argsort(self.index.order).tolist())]
        share = np.where(labels == 1, totals[1] / n1, totals[0] / n0)
        some = np.array([v is not None for v in votes])
        lonely = share[~some]
        self.alone = float((lonely * labels[~some]).sum() + self.prior) / float(lonely.sum() + 1)
        if some.any():
            self.slope, self.base = _logistic(np.array([v for v in votes if v is not None]), labels[some], share[some], self.prior)

    def weighted(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.importance[term]
        norm = np.sqrt((w * w).sum())
        keep = w > 0
        return term[keep], w[keep] / norm if norm > 0 else w[keep]

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float | None, np.ndarray]]:
        """The share of the neighbours' votes that are for label 1, or None without neighbours, and the neighbours."""
        out = []
        for i, c in self.index.nearest(queries, NEIGHBOURS, without) if self.index.n else [(np.zeros(0, np.int64),) * 2] * len(queries):
            near = c / (1.05 - np.minimum(c, 1))
            out.append((float((near * self.index.labels[i]).sum() / near.sum()) if len(i) else None, i))
        return out

    def score(self, v: float | None) -> float:
        return self.alone if v is None else float(1 / (1 + np.exp(-np.clip(self.slope * v + self.base, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """Weighted logistic regression on one input, with two made-up rows at its ends so that it stays finite."""
    x, y, w = np.append(x, [0.0, 1.0, 0.5, 0.5]), np.append(y, [0, 1, 1, 0]), np.append(w, [1.0, 1.0, prior, 1 - prior])
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 1e-3 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _frequencies(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in chunks(off):
                _, term, _ = counted(known, data[off[i] : off[j]], off[i : j + 1] - off[i])
                total += np.bincount(term, minlength=len(total))
            n += batch.num_rows
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1), pa.int32()), pa.array(np.append(total[k], n), pa.int64())], ["term", "n"])
        give_back()

    return run


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        told: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunks(off):
                row, term, n = counted(m.hashes, data[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = np.searchsorted(row, np.arange(j - i + 1)).tolist()
                lists = [(term[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                keys = [hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() for t, c in lists]
                if len(told) > REMEMBERED:
                    told.clear()
                new = {key: x for key, x in zip(keys, lists, strict=True) if key not in told}
                for key, (v, near) in zip(new, m.votes([m.weighted(*x) for x in new.values()]), strict=True):
                    told[key] = m.score(v), [m.index.ids[x] for x in near[:3]]
                score, evidence = ([told[key][x] for key in keys] for x in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), *(c.slice(i, j - i) for c in batch.columns[1:])], names=["id", "score", "evidence", *batch.schema.names[1:]])
        give_back()

    return run


def fitted(docs: DataFrame, examples: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> Model:
    """The model. examples: columns id and label (0 or 1) of training rows; EXAMPLES of each class are fitted, taken by hash of the id,
    and of those as many, in this order, as have EXAMPLE_TERMS distinct words together (one at least).

    Repeated ids count once (the greater label holds; their rows are examples each); rows without an id or label are left out. With fewer than two classes scores are 0
    or 1, whichever class there is, and 0 without any examples.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = examples.where("id is not null and label is not null").groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label"))
    n = {r.label: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    totals = (n.get(0, 0), n.get(1, 0))
    sample = None
    for y in (0, 1):
        part = own.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES)
        sample = part if sample is None else sample.unionByName(part)
    # 2 * EXAMPLES rows at most
    near = rows.join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(_document_terms, "id long, label int, m long, terms binary, counts binary")
    near = scratch.cut(near.withColumn("place", F.xxhash64("id")), "examples")
    last, size = None, 0
    for r in near.groupBy("place").agg(F.sum("m").alias("m")).orderBy("place").collect():
        size += r.m
        if last is None or size <= EXAMPLE_TERMS:
            last = r.place
    got = near.where(F.col("place") <= last).toArrow() if last is not None else near.limit(0).toArrow()
    scratch.drop(near)
    got = got.sort_by([("id", "ascending"), ("terms", "ascending"), ("counts", "ascending")])
    sets = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.int64)) for t, c in zip(got["terms"].to_pylist(), got["counts"].to_pylist(), strict=True)]
    labels, ids = got["label"].to_numpy().astype(np.int64), got["id"].to_pylist()
    del got
    vocabulary = np.unique(np.concatenate([t for t, _ in sets])) if sets else np.zeros(0, np.uint64)
    kept = [(np.searchsorted(vocabulary, t), c) for t, c in sets]
    holders = np.zeros((len(vocabulary), 2))
    for (k, _), y in zip(kept, labels, strict=True):
        holders[k, y] += 1
    shared = spark.sparkContext.broadcast(vocabulary)
    seen = rows.select("text").mapInArrow(_frequencies(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    df, total = np.zeros(len(vocabulary) + 1), 0
    df[seen["term"].to_numpy()] = seen["n"].to_numpy()
    # term -1 counts the rows
    df, total = df[:-1], df[-1]
    idf = np.log((2 + total) / (1 + df))
    model = Model(vocabulary, idf * relevance(holders, (int((labels == 0).sum()), int((labels == 1).sum()))), kept, labels, ids, totals)
    del kept, holders, seen, sets
    settle(spark)
    return model


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep: str = "true") -> DataFrame:
    """One row per document: id, score (0 to 1), evidence (ids of up to 3 nearest examples), then the columns named in carry.

    Of our columns those are left out whose names are carried. keep is a condition on our columns; other rows go.

    A text without known terms, such as an empty or null one, scores as such examples do. Repeated rows and rows without an id are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src, schema, back = carried(docs, id_col, text_col, carry or [])
    return src.mapInArrow(_scores(shared), "id long, score double, evidence array<long>" + schema).where(keep).select(*own_columns(["id", "score", "evidence"], carry), *back)


def fold(id_col: str, folds: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds

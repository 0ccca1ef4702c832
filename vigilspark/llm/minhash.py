"""Near-duplicate documents: universal-hash minima, banding, signature verification, confirmation on full sets, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import BLANK_WORD, LOWER, Scratch, chunks, give_back, mix, runs, utf8, word_hashes, words

#: Hashes in a band; the number of bands follows from the threshold.
ROWS = 5
#: Chance at most that a pair right at the threshold shares no band.
MISS = 1e-6
#: Buckets of more members are taken as one candidate group without a look at signatures; all members are compared on full sets later.
WIDE = 256
#: Documents of a candidate group that meet in one task. Larger groups are cut into blocks, each of which meets about PIVOTS members of its group; only
#: groups that don't hold together by that are compared block by block.
BLOCK, PIVOTS = 512, 16
#: Members of candidate groups up to which they are broadcast to the texts, so that no other text is shuffled.
FEW = 500_000
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each row's shingles."""
    buf = LOWER[buf]
    s, e, at = words(buf, off, BLANK_WORD)
    out: list[np.ndarray] = []
    if not len(s):
        return [np.zeros(0, np.uint64)] * (len(off) - 1)
    h = word_hashes(buf, s, e)
    steps = np.resize(_STEP, size) + np.arange(size, dtype=np.uint64) * np.uint64(2)
    full = sum((h[k : len(h) - size + 1 + k] * steps[k] for k in range(size)), np.zeros(max(0, len(h) - size + 1), np.uint64)) if len(h) >= size else np.zeros(0, np.uint64)
    full = mix(full + np.uint64(size))
    for i, j in zip(at[:-1], at[1:], strict=True):
        n = j - i
        if n >= size:
            a = np.sort(full[i : j - size + 1])
            out.append(a[np.append(True, a[1:] != a[:-1])])
        elif n:
            out.append(mix(np.array([(h[i:j] * steps[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of (a x + b) mod 2**64 over the set, by its upper 32 bits, for each universal hash."""
    best = np.full(len(a), 2**32 - 1, np.uint64)
    for i in range(0, len(values), 1024):
        x = values[None, i : i + 1024] * a[:, None]
        x += b[:, None]
        np.minimum(best, x.min(1) >> np.uint64(32), out=best)
    return best


def _signatures(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal(bands * ROWS)
        steps, band = np.resize(_STEP, ROWS)[None, :], np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunks(off):
                n, keys, sigs, bkeys = [], [], [], []
                for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    n.append(len(s))
                    if len(s):
                        m = minima(s, a, b)
                        keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        sigs.append(m.astype(np.uint16).tobytes())
                        bkeys.append(mix((m.reshape(bands, ROWS) * steps).sum(1, dtype=np.uint64) + band).tobytes())
                    else:
                        keys.append(None), sigs.append(None), bkeys.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bkeys, pa.binary())], ["id", "n", "key", "sig", "bands"])
        give_back()

    return run


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        if blobs:
            k = np.frombuffer(b"".join(blobs), np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), len(k) // len(blobs))
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000]), pa.array(ids[i : i + 100_000])], ["bucket", "id"])


def _forest(linked: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a symmetric matrix of links: each node but the least of its component, with that least one."""
    n, todo, u, v = len(ids), np.ones(len(ids), bool), [], []
    for k in np.argsort(ids, kind="stable"):
        if todo[k]:
            todo[k], front = False, [k]
            while front:
                reached = linked[front].any(0) & todo
                todo &= ~reached
                front = np.flatnonzero(reached).tolist()
                u += ids[front].tolist()
                v += [int(ids[k])] * len(front)
    assert not todo.any() and len(u) < max(1, n)
    return u, v


def _edges(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _agreeing(least: float):
    """Of each bucket: links between members whose signatures agree in so great a part, as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for t in runs(batches, ["bucket"]):
            ids = t.column("id").to_numpy()
            if len(ids) > 1:
                s = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
                same = np.stack([(s == row).sum(1) for row in s])
                u, v = _forest(same >= least * s.shape[1], ids)
                us += u
                vs += v
                if len(us) > 50_000:
                    yield _edges(us, vs)
                    us, vs = [], []
        yield _edges(us, vs)

    return run


def _set_blobs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            for i, j in chunks(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "blocks", "set"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; exact."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], np.float32)
    out = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        edges = np.searchsorted(column, np.arange(0, column[-1] + 2048, 2048))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            x = np.zeros((m, 2048), np.float32)
            x[owner[i:j], column[i:j] % 2048] = 1
            out += x @ x.T
    return out


def _confirmed(num: int, den: int):
    """Of each block or pair of blocks: the links with den * intersection >= num * union, as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for t in runs(batches, ["cluster", "i", "j"]):
            ids = t.column("id").to_numpy()
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            both = common_counts(sets)
            n = np.array([len(s) for s in sets], np.int64)
            union = n[:, None] + n[None, :] - both.astype(np.int64)
            u, v = _forest(den * both.astype(np.int64) >= num * union, ids)
            us += u
            vs += v
        yield _edges(us, vs)
        give_back()

    return run


def near_duplicates(docs: DataFrame, *, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set is the distinct shingles of ``shingle`` words, or the
    whole sequence where there are fewer. Documents are linked if 100 * intersection >= percent * union;
    component_id is the least id reachable by links, kept is id = component_id.

    Documents with equal sets are one class from the start (partial minimum). Signatures of classes are banded; small buckets
    are checked on signatures and give candidate groups, wide buckets give them unchecked; every link is then confirmed on
    full sets, in blocks of a bounded number of documents for large groups. Only spanning forests leave a task, never all
    pairs of a group. Of a large group that links to its pivots hold together each set is shuffled once, and pivots once a block.

    Empty and null texts have n_shingles 0 and are linked with nothing. Rows that share an id are one node. Rows without an
    id have no component (null) and are kept. Other columns of docs are ignored, so their names can't clash.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    bands, threshold = bands_for(percent / 100), percent / 100
    sigma = math.sqrt(threshold * (1 - threshold) / (bands * ROWS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_rows = scratch.cut(rows.mapInArrow(_signatures(bands), "id long, n long, key binary, sig binary, bands binary"), "signatures")
    classes = all_rows.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep"))
    reps = scratch.cut(
        all_rows.where("key is not null").join(classes.select(F.col("key").alias("k"), F.col("rep").alias("id")), "id").where("key = k").dropDuplicates(["id", "key"]).select("id", "key", "sig", "bands"),
        "classes",
    )

    buckets = reps.select("id", "bands").mapInArrow(_explode_bands, "bucket long, id long")
    met = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    members = scratch.cut(buckets.join(met, "bucket"), "buckets")
    stars = members.where(f"n > {WIDE} and id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    narrow = members.where(f"n <= {WIDE}").select("bucket", "id").join(reps.select("id", "sig"), "id")
    agreed = narrow.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_agreeing(threshold - 5.2 * sigma), "u long, v long")
    clusters = connected_components(stars.unionByName(agreed), scratch)

    sizes = clusters.groupBy("component").agg(F.count("*").alias("m"))
    placed = clusters.join(sizes, "component").select(F.col("node").alias("id"), F.struct(F.col("component").alias("cluster"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")).alias("blocks"))
    placed = scratch.cut(placed, "placed")
    own = F.pmod(F.xxhash64("id"), F.col("blocks.blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks.blocks") - 1)

    def met_sets(some: DataFrame, others: F.Column) -> DataFrame:
        """Links of the sets of some members, in the blocks (i, j) of their group that they go to."""
        some = some.join(reps.select("id"), "id")
        texts = rows.where("id is not null and text is not null").join(F.broadcast(some) if some.limit(FEW + 1).count() <= FEW else some, "id")
        sets = texts.select("id", "blocks", "text").mapInArrow(_set_blobs(shingle), "id long, blocks struct<cluster:long,blocks:int>, set binary")
        met = sets.select("id", "set", F.col("blocks.cluster").alias("cluster"), F.explode(others).alias("at")).select("id", "set", "cluster", "at.i", "at.j")
        return met.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_confirmed(percent, 100), "u long, v long")

    # each member in its block, and pivots in all blocks of their group
    is_pivot = F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.col("blocks.blocks") * BLOCK / PIVOTS)) == 0
    confirmed = scratch.cut(met_sets(placed, F.when(is_pivot, F.transform(everywhere, lambda i: F.struct(i.alias("i"), i.alias("j")))).otherwise(F.array(F.struct(own.alias("i"), own.alias("j"))))), "links")
    linked = connected_components(confirmed, scratch)
    state = placed.where("blocks.blocks > 1").join(linked.withColumnRenamed("node", "id"), "id", "left").select(F.col("blocks.cluster").alias("cluster"), F.coalesce("component", "id").alias("c"))
    split = scratch.cut(state.groupBy("cluster").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("cluster"), "split")
    if split.limit(1).count():
        rest = placed.join(split, F.col("blocks.cluster") == F.col("cluster"), "left_semi")
        pairs = F.transform(everywhere, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
        linked = connected_components(confirmed.unionByName(met_sets(rest, pairs)), scratch)
    scratch.drop(members, clusters)

    known = reps.select("key", F.col("id").alias("rep")).join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = all_rows.select("id", "n", "key").join(known, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

"""What the operators share: the folder for written tables, text as bytes, hashes of spans."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that the vectorised scans take at once; one longer document is taken whole.
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- written tables


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one of our own only where none is set and all tasks run in this machine's one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vigilspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to cut lineage. ``drop`` deletes what a later result doesn't read."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        settle(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vigil_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._vigil_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def carried(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, str, list]:
    """Columns id and text under names of ours with the carried ones after them (the text itself once), their schema, and how to name them back."""
    rest = [c for c in carry if c != text_col]
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__t"), *[F.col(f"`{c}`").alias(f"__c{x}") for x, c in enumerate(rest)])
    schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    names = {c: f"__c{x}" for x, c in enumerate(rest)} | {text_col: "__t"}
    return src, schema, [F.col(names[c]).alias(c) for c in carry]


def own_columns(names: list[str], carry: list[str] | None) -> list[str]:
    return [n for n in names if n not in (carry or [])]


# ---------------------------------------------------------------- bytes


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offset of each row; null is empty."""
    a = col.cast(pa.large_binary())
    if a.null_count:
        a = pc.fill_null(a, b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data, off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but space and \t to \r.
BLANK_WORD = np.ones(256, bool)
BLANK_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: digits, letters and all that isn't ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[48:58] = ALNUM_WORD[65:91] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more entry than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1][off[1:] > off[:-1]]
    first[full] = inside[full]
    ends = off[1:][off[1:] > off[:-1]] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


# ---------------------------------------------------------------- hashes

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 2**64)
_pow = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        a = np.full(size, base, np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if size <= 2 * CHUNK_BYTES:
            _pow[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time, each step mixed before the next, so that no pattern of bytes cancels out.

    Words of over _LONG bytes, of which there are few, are hashed one by one.
    """
    n = e - s
    h = mix(n.astype(np.uint64) * np.uint64(_R) + np.uint64(0x2545F4914F6CDD1D))
    if not len(s):
        return h
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))
    on = np.arange(len(s)) if n.max() <= _LONG else np.flatnonzero(n <= _LONG)
    at, left = s[on], n[on]
    while len(on):
        h[on] = mix((h[on] ^ (lanes[at] & _MASKS[np.minimum(left, 8)])) * np.uint64(_R))
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[s[i] : e[i]].tobytes())
    return h


_LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A Mersenne prime, and two bases of the polynomials modulo it.
_P = np.uint64(2**31 - 1)
_BASES = (1_103_515_245, 1_812_433_253)


def _residues(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    x[x >= _P] -= _P
    return x


def _prime_powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(-base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.ones(size, np.uint32)
        k, step = 1, base
        while k < size:
            m = min(k, size - k)
            have[k : k + m] = _residues(have[:m] * np.uint64(step))
            step, k = step * step % int(_P), k * 2
        if size <= 2 * CHUNK_BYTES:
            _pow[-base] = have
    return have[:n]


class Spans:
    """Hashes of any spans of a buffer, from passes of prefix sums.

    ``grams`` is a polynomial modulo 2**64, for short strings. ``of`` adds to it two polynomials modulo a prime, which patterns of
    bytes that cancel modulo powers of two don't touch.
    """

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _powers(_R, n), out=self.prefix[1:])
        self.inverse = _powers(_R_INV, n + 1)
        self.buf, self.primes = buf, None

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if self.primes is None:
            self.primes = []
            for base in _BASES:
                powers = _prime_powers(base, len(self.buf))
                sums, last = np.zeros(len(self.buf) + 1, np.uint32), np.uint64(0)
                for i in range(0, len(self.buf), CHUNK_BYTES):
                    # terms are below 2**39, so sums over a part are exact
                    part = np.cumsum((self.buf[i : i + CHUNK_BYTES].astype(np.uint64) + np.uint64(1)) * powers[i : i + CHUNK_BYTES])
                    part = _residues(part + last)
                    sums[i + 1 : i + 1 + len(part)], last = part, part[-1]
                self.primes.append((sums, _prime_powers(pow(base, -1, int(_P)), len(sums))))
        out = mix((self.prefix[e] - self.prefix[s]) * self.inverse[s] + (e - s).astype(np.uint64))
        first, second = (_residues(_residues(sums[e] + _P - sums[s]) * back[s].astype(np.uint64)) for sums, back in self.primes)
        return mix(out ^ (first << np.uint64(31) | second))

    def grams(self, q: int) -> np.ndarray:
        return mix((self.prefix[q:] - self.prefix[:-q]) * self.inverse[: len(self.prefix) - q] + np.uint64(q))


# ---------------------------------------------------------------- memory

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: What operators remember from task to task, by name, and how each forgets it.
remembered: dict[str, Callable[[], None]] = {}


def give_back(own: str | None = None) -> None:
    """What other operators remember is forgotten, and freed memory goes back to the system, as a worker lives on for tasks of other operators."""
    for name, forget in remembered.items():
        if name != own:
            forget()
    if _trim:
        _trim(0)


#: Seconds at least between two collections that settle() asks the driver's JVM for, and the last one's time.
COLLECT_S = 10
_collected = [0.0]


def settle(spark: SparkSession) -> None:
    """What the driver has freed goes back to the system: Python's, Arrow's and the JVM's native memory, and the JVM's heap where three quarters of it are in use."""
    jvm = spark._jvm
    pa.default_memory_pool().release_unused()
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 4 * runtime.totalMemory() >= 3 * runtime.maxMemory() and time.monotonic() - _collected[0] >= COLLECT_S:
        # Python's garbage holds the JVM's plans and broadcasts
        gc.collect()
        jvm.System.gc()
        _collected[0] = time.monotonic()
    if _trim:
        _trim(0)
    try:
        array, server = spark.sparkContext._gateway.new_array, jvm.java.lang.Class.forName("javax.management.MBeanServer")
        own = array(jvm.Object, 4)
        own[0], own[1], own[2], own[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0)
        next(m for m in server.getMethods() if m.getName() == "invoke").invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), own)
    except Py4JError:
        # JVMs before 17.0.9 and those of other systems have no such command
        pass


# ---------------------------------------------------------------- groups of sorted rows


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        at = [tuple(c[i].as_py() for c in cols) for i in (0, n - 1)]
        cuts = np.zeros(n, bool)
        cuts[0] = at[0] != last
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            cuts[1:] |= v[1:] != v[:-1]
        edges = np.append(np.flatnonzero(cuts), n)
        if edges[0] > 0:
            held.append(batch.slice(0, edges[0]))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(i, j - i)]
        last = at[1]
    if held:
        yield pa.Table.from_batches(held)


def binaries(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())

"""A gated recurrent language model with class-factored softmax: truncated backpropagation in numpy, state carried over whole documents.

Tokens are words and an end. Their counts, by group of similar training documents, come from all training documents; a word's class is
its main group and its band of frequency. Words seen once share a class with all unseen ones. P(token) is P(class | state) times P(token | class, state), two softmaxes of the
network. The second is over the READ commonest words of the class and one entry for all its others, among which counts decide. Probabilities over the seen tokens and one unseen token sum to 1.

The network reads the commonest words and the classes of others. It begins with a few passes over a bounded sample; then all training documents train it,
each once, in ROUNDS rounds: every task starts from the weights so far and trains on its documents of the round, and the weights are averaged by tokens.
Training goes by windows of WINDOW tokens through which gradients flow, the state going on from window to window for SEGMENT tokens; scoring carries it to a document's end. The commonest words' counts are broadcast, a bounded number; those of all others are
looked up by shuffle.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BUCKET_BYTES, ROWS, _dealt, _rows, _send_texts, doc_bucket, pack, text_mark, unpack
from .shared import BLANK_WORD, LOWER, Scratch, chunks, give_back, mix, parts, runs, utf8, word_hashes, words

#: Documents and tokens of the network's first passes, at most; documents and bytes, about, whose commonest words and centres groups begin with, and the longest such document.
TRAIN_DOCS, TRAIN_TOKENS, GROUP_DOCS, GROUP_BYTES, GROUP_LONGEST = 600, 300_000, 2000, 16_000_000, 1_000_000
#: Tokens through which the state goes on in training.
SEGMENT = 512
GROUPS, UNITS, READ, WINDOW, BATCH, PASSES = 8, 24, 512, 32, 32, 4
#: Rounds that share out all training documents, documents in a batch and rate of the first round, tokens that a task holds to sort by length.
ROUNDS, ROUND_BATCH, ROUND_RATE, ROUND_TOKENS = 4, 256, 0.002, 1_000_000
#: Steps by which all training documents move the groups' centres.
MOVES = 2
#: Words whose counts are broadcast, and upper bounds of bands of relative frequency.
HEAD = 50_000
BANDS = np.array([1e-6, 1e-5, 1e-4, 1e-3])
#: Upper bits of a hash by which the commonest words are looked up.
SLOT_BITS = 18
#: Words that describe a document when groups are fitted.
SIGNS = 64
END = np.uint64(1)
#: Words that a task holds before it sends them.
HELD = 1_500_000
#: Bytes of text that a task reads, and tokens that it scores, at once; one longer document is taken whole.
SCORED_BYTES, SCORED_TOKENS = 2_000_000, 4_000_000
#: States whose softmaxes are taken at once.
STATES = 16_000

#: A row of a table of words: hash, count, group.
_KINDS = ("u8", "i8", "u1")


def token_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row with END after them, and the offsets of rows."""
    buf = LOWER[buf]
    s, e, at = words(buf, off, BLANK_WORD)
    own = np.maximum(word_hashes(buf, s, e), np.uint64(16)) if len(s) else np.zeros(0, np.uint64)
    ends = at[1:] + np.arange(1, len(off))
    out = np.full(len(own) + len(off) - 1, END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = own
    return out, np.append(0, ends)


def counted(h: np.ndarray, off: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """How often each row has each of the signs."""
    n = len(off) - 1
    k = np.searchsorted(signs, h)
    k[k == len(signs)] = 0
    hit = signs[k] == h
    row = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(row[hit] * len(signs) + k[hit], minlength=n * len(signs)).reshape(n, -1)


def described(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Roots of the shares that the signs have of rows."""
    return np.sqrt(counts.astype(float) / np.maximum(1, lengths)[:, None])


def _centred(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)


def grouped(h: np.ndarray, off: np.ndarray, signs: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The group of each row, by the commonest words in it."""
    n = len(off) - 1
    if not len(signs) or not n:
        return np.zeros(n, np.int64)
    return _centred(described(counted(h, off, signs), np.diff(off)), centres)


def _fit_groups(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not docs:
        return np.zeros(0, np.uint64), np.zeros((1, 0))
    u, n = np.unique(np.concatenate(docs), return_counts=True)
    keep = u != END
    u, n = u[keep], n[keep]
    signs = np.sort(u[np.argsort(-n, kind="stable")[:SIGNS]])
    if not len(signs):
        return signs, np.zeros((1, 0))
    x = np.zeros((len(docs), len(signs)))
    for i, d in enumerate(docs):
        k = np.searchsorted(signs, d)
        k[k == len(signs)] = 0
        x[i] = np.sqrt(np.bincount(k[signs[k] == d], minlength=len(signs)) / max(1, len(d)))
    # the farthest row first, again and again, then k-means
    centres = [x.mean(0)]
    for _ in range(min(GROUPS, len(docs)) - 1):
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], 0).argmax()])
    c = np.array(centres)
    for _ in range(20):
        own = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[own == g].mean(0) if (own == g).any() else c[g] for g in range(len(c))])
    return signs, c


#: The rows of a piece of text, as words in each and how often each has each of the signs, compressed.
SIGN_ROWS = "lengths binary, counts binary"


def _signed(signs: np.ndarray):
    """What moves of centres need of each text, so that they don't cut it into words again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in chunks(off):
                h, at = token_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                both = np.diff(at).astype(np.int64), counted(h, at, signs).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([small.compress(x.tobytes())], pa.binary()) for x in both], ["lengths", "counts"])

    return run


def _moves(centres: np.ndarray):
    """Sums and numbers of the task's documents by nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, squeeze = np.zeros(centres.shape), np.zeros(len(centres)), zstandard.ZstdDecompressor()
        for batch in batches:
            for lengths, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lengths, counts = (np.frombuffer(squeeze.decompress(x), np.int64) for x in (lengths, counts))
                x = described(counts.reshape(len(lengths), -1), lengths)
                g = _centred(x, centres)
                np.add.at(sums, g, x)
                n += np.bincount(g, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(list(sums), pa.list_(pa.float64()))], ["g", "n", "sums"])

    return run


def _count(signs: np.ndarray, centres: np.ndarray, buckets: int):
    """Counts of each word by group of documents, summed in the task, by bucket of words."""

    def flush(held: list) -> Iterator[tuple[int, int, bytes]]:
        h = np.concatenate([x for x, _, _ in held])
        g = np.concatenate([x for _, x, _ in held]).astype(np.int64)
        n = np.concatenate([x for _, _, x in held])
        order = np.lexsort((g, h))
        h, g, n = h[order], g[order], n[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
        h, g, n = h[new], g[new], np.add.reduceat(n, new)
        yield from _dealt(0, mix(h) % np.uint64(buckets), [h, n, g], _KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            held, size = [], 0
            for batch in batches:
                data, off = utf8(batch.column(0))
                for i, j in chunks(off):
                    h, at = token_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    g = np.repeat(grouped(h, at, signs, centres), np.diff(at)).astype(np.uint64)
                    # group within the hash, so that one sort counts both
                    key, n = np.unique((h & ~np.uint64(15)) | g, return_counts=True)
                    held.append((key & ~np.uint64(15), key & np.uint64(15), n))
                    size += len(key)
                    if size > HELD:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)

        yield from _rows(rows())

    return run


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket of words: hash, count and main group."""

    def rows() -> Iterator[tuple[int, int, bytes]]:
        for t in runs(batches, ["bucket"]):
            h, n, g = unpack(t.column("blob").to_pylist(), _KINDS)
            order = np.lexsort((g, h))
            h, g, n = h[order], g[order], n[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            h, g, n = h[new], g[new], np.add.reduceat(n, new)
            word = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            total = np.add.reduceat(n, word)
            by_most = np.lexsort((g, -n, h))
            main = g[by_most][np.flatnonzero(np.append(True, h[by_most][1:] != h[by_most][:-1]))]
            yield t.column("bucket")[0].as_py(), 0, pack([h[word], total, main], _KINDS)

    yield from _rows(rows())


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's words: how many of each group and count up to 64, and of each power of 2 ** 0.5 beyond."""
    for batch in batches:
        for blob in batch.column(2).to_pylist():
            _, n, g = unpack([blob], _KINDS)
            step = np.where(n <= 64, n, 64 + np.ceil(2 * np.log2(np.maximum(n, 1) / 64)).astype(np.int64))
            key, at = np.unique(step * 16 + g, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // 16), pa.array(np.bincount(at)), pa.array(np.bincount(at, n).astype(np.int64))], ["step", "words", "tokens"])


def _by_class(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                h, n, g = unpack([blob], _KINDS)
                c = classes(np.where(h == END_KEY, END, h), n, g, total)
                k = np.unique(c)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(c, n)[k].astype(np.int64))], ["c", "tokens"])

    return run


RARE, LAST = 0, 1


def classes(h: np.ndarray, n: np.ndarray, g: np.ndarray, total: int) -> np.ndarray:
    """RARE (seen at most once), LAST (the end) or group and band of frequency."""
    out = 2 + g.astype(np.int64) * (len(BANDS) + 1) + np.searchsorted(BANDS, n / max(1, total), "right")
    out[n <= 1] = RARE
    out[h == END] = LAST
    return out


N_CLASSES = 2 + GROUPS * (len(BANDS) + 1)


def _matching(wanted: np.ndarray | None, least: int):
    """Words among the wanted ones, or those of so great a count and the end, however rare, as no task asks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                h, n, g = unpack([blob], _KINDS)
                keep = np.isin(h, wanted) if wanted is not None else (n >= least) | (h == END_KEY)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep]), pa.array(g[keep].astype(np.int64))], ["h", "n", "g"])

    return run


# ---------------------------------------------------------------- the network


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.moment, self.t = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}, 0

    def step(self, w: dict[str, np.ndarray], grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, dv in grads.items():
            np.clip(dv, -1, 1, out=dv)
            m, v = self.moment[k]
            m += 0.1 * (dv - m)
            v += 0.001 * (dv * dv - v)
            w[k] -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Network:
    """A gated recurrent unit that reads symbols and gives log-probabilities of classes and of the words that it reads within their classes.

    Symbols are the classes and then the words read; ``own`` has the class of each of these, ``shares`` their shares of their classes' counts.
    """

    def __init__(self, classes_: int, own: np.ndarray, shares: np.ndarray, units: int = UNITS, seed: int = 3):
        r = np.random.default_rng(seed)
        f = np.float32
        symbols = classes_ + len(own)
        rest = np.maximum(0, 1 - np.bincount(own, shares, minlength=classes_)) if len(own) else np.ones(classes_)
        rest[rest < 1e-9] = 0
        self.w = {
            "x": (r.normal(0, 0.1, (symbols, 3 * units))).astype(f),
            "u": (r.normal(0, 1 / np.sqrt(units), (units, 3 * units))).astype(f),
            "o": (r.normal(0, 0.1, (units, classes_))).astype(f),
            "b": np.zeros(classes_, f),
            # a symbol that is a class stands for all its words that aren't read
            "v": (r.normal(0, 0.02, (units, symbols))).astype(f),
            "d": np.log(np.maximum(np.append(rest, shares), 1e-12)).astype(f),
        }
        self.units, self.classes = units, classes_
        #: of each class with words that are read: its symbols; of each symbol: its place among those of its class
        self.members = {int(c): np.append(np.flatnonzero(own == c) + classes_, [c] if rest[c] > 0 else []).astype(np.int64) for c in np.unique(own)}
        self.place = np.zeros(symbols, np.int64)
        for m in self.members.values():
            self.place[m] = np.arange(len(m))

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """States are columns, here and below, so that each gate's rows lie together."""
        k = self.units
        a = np.ascontiguousarray(self.w["x"].take(x, 0).T)
        p = self.w["u"].T @ h
        # the logistic function by way of tanh, which can't overflow
        zr = a[: 2 * k]
        zr += p[: 2 * k]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r, c, p = zr[:k], zr[k:], a[2 * k :], p[2 * k :]
        c += r * p
        np.tanh(c, out=c)
        after = c - h
        after *= z
        after += h
        return after, z, r, c, p

    def exps(self, y: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """exp(y), y being out.T @ states + bias; where weights are great, y loses its greatest entry in each column first."""
        if float((np.abs(out).sum(0) + np.abs(bias)).max(initial=0)) > 60:
            y -= y.max(0)
        return np.exp(y)

    def classes_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each column the scores of classes and their exponentials."""
        y = self.w["o"].T @ h
        y += self.w["b"][:, None]
        return y, self.exps(y, self.w["o"], self.w["b"])

    def words_of(self, h: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each column the scores of a class's symbols and their exponentials."""
        v, d = self.w["v"][:, members], self.w["d"][members]
        y = v.T @ h
        y += d[:, None]
        return y, self.exps(y, v, d)

    def words(self, symbols: np.ndarray, told: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each class with words that are read: the places of its tokens, its symbols, and the place of each token's symbol among them."""
        order = np.argsort(told.astype(np.int16), kind="stable")
        edges = np.searchsorted(told[order], np.arange(self.classes + 1))
        for c, m in self.members.items():
            at = order[edges[c] : edges[c + 1]]
            if len(at):
                yield at, m, self.place[symbols[at]]

    def train(self, streams: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, window: int = WINDOW, batch: int = BATCH, rate: float = 0.01) -> list[float]:
        """Adam on windows; streams are (symbols read, classes to tell), one for each document, each from a zero state. Returns the mean loss of each pass."""
        adam = Adam(self.w)
        rng, losses = np.random.default_rng(7), []
        for _ in range(passes):
            losses.append(self.passed(streams, adam, rng, window, batch, rate))
            rate *= 0.6
        return losses

    def passed(self, streams: list[tuple[np.ndarray, np.ndarray]], adam: Adam, rng: np.random.Generator, window: int, batch: int, rate: float) -> float:
        """One pass; returns the mean loss. Documents of like length share a batch, and those that have ended leave it."""
        order = sorted(rng.permutation(len(streams)), key=lambda i: -(len(streams[i][1]) // 64))
        groups = [sorted(order[i : i + batch], key=lambda i: -len(streams[i][1])) for i in range(0, len(order), batch)]
        loss = count = 0.0
        for g in rng.permutation(len(groups)):
            own = [streams[i] for i in groups[g]]
            lengths = np.array([len(c) for _, c in own])
            h = np.zeros((self.units, len(own)), self.w["u"].dtype)
            for i in range(0, int(lengths[0]), window):
                own = own[: int((lengths > i).sum())]
                xs, cs = np.zeros((min(window, int(lengths[0]) - i), len(own)), np.int64), np.full((min(window, int(lengths[0]) - i), len(own)), -1)
                for k, (x, c) in enumerate(own):
                    part = c[i : i + window]
                    xs[: len(part), k], cs[: len(part), k] = x[i : i + window], part
                grads, h, own_loss, n = self._window(np.ascontiguousarray(h[:, : len(own)]), xs, cs)
                loss, count = loss + own_loss, count + n
                adam.step(self.w, grads, rate)
        return loss / max(1, count)

    def _window(self, h: np.ndarray, xs: np.ndarray, cs: np.ndarray):
        k, kept, before = self.units, [], []
        total = max(1, int((cs >= 0).sum()))
        for x in xs:
            before.append(h)
            h, *gates = self.step(h, x)
            kept.append(gates)
        steps, many = xs.shape
        states = np.concatenate(before, 1)
        c = cs.reshape(-1)
        on = np.flatnonzero(c >= 0)
        loss = 0.0

        def told_of(y: np.ndarray, e: np.ndarray, at: np.ndarray, columns: np.ndarray) -> np.ndarray:
            """The gradient of the loss with regard to the scores, in place of their exponentials."""
            nonlocal loss
            sums = e.sum(0)
            loss -= float((y[at, columns] - np.log(sums[columns])).sum())
            e /= sums * total
            e[at, columns] -= 1 / total
            return e

        d = told_of(*self.classes_of(states), c[on], on)
        if len(on) < len(c):
            d[:, c < 0] = 0
        grads = {"o": states @ d.T, "b": d.sum(1), "v": np.zeros_like(self.w["v"]), "d": np.zeros_like(self.w["d"])}
        told = self.w["o"] @ d
        for columns, members, at in self.words(xs.reshape(-1)[on], c[on]):
            columns = on[columns]
            own = states.take(columns, 1)
            d = told_of(*self.words_of(own, members), at, np.arange(len(columns)))
            grads["v"][:, members] = own @ d.T
            grads["d"][members] = d.sum(1)
            told[:, columns] += self.w["v"][:, members] @ d
        told = told.reshape(k, steps, many)
        back, u = np.zeros_like(h), self.w["u"]
        da, dps = np.empty((3 * k, steps, many), h.dtype), np.empty((3 * k, steps, many), h.dtype)
        ones = np.ones_like(h)
        for t in range(steps - 1, -1, -1):
            # through the step from before to after, then the output at before
            z, r, cand, p = kept[t]
            dp = np.empty((3 * k, many), h.dtype)
            zs = back * z
            rest = back - zs
            np.multiply(rest, cand - before[t], out=dp[:k])
            dp[:k] *= z
            dc = cand * cand
            np.subtract(ones, dc, out=dc)
            dc *= zs
            np.multiply(dc, r, out=dp[2 * k :])
            np.subtract(ones, r, out=zs)
            zs *= p
            np.multiply(zs, dp[2 * k :], out=dp[k : 2 * k])
            da[: 2 * k, t], da[2 * k :, t], dps[:, t] = dp[: 2 * k], dc, dp
            back = u @ dp
            back += rest
            back += told[:, t]
        grads["u"] = states @ dps.reshape(3 * k, -1).T
        x = xs.reshape(-1)
        order = np.argsort(x.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(x[order]) > 0))
        grads["x"] = np.zeros_like(self.w["x"])
        # unit by unit, of which each row of gradients stays in the cache
        grads["x"][x[order][first]] = np.add.reduceat(da.reshape(3 * k, -1).take(order, 1), first, axis=1).T
        return grads, h, loss, total

    def scores(self, symbols: np.ndarray, told: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Natural log-probability of the classes of each row and of the words that are read within them, the state going on from window to window to its end."""
        n = np.diff(off)
        order = np.argsort(-n, kind="stable")
        start, length = off[:-1][order], n[order]
        out = np.zeros(len(order))
        h = np.zeros((self.units, len(order)), np.float32)
        active = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(length) else 0) + 1), "right")
        held, at, size = [], [], 0

        def take() -> None:
            states, i = np.concatenate(held, 1), np.concatenate(at)
            row = np.concatenate([np.arange(len(x)) for x in at])
            x, c, many = symbols[i], told[i], len(at[0])

            def add(y: np.ndarray, e: np.ndarray, place: np.ndarray, own: np.ndarray) -> None:
                out[:many] += np.bincount(own, y[place, np.arange(len(place))] - np.log(e.sum(0)), minlength=many)

            add(*self.classes_of(states), c, row)
            for columns, members, place in self.words(x, c):
                add(*self.words_of(states.take(columns, 1), members), place, row[columns])

        for t, m in enumerate(active.tolist()):
            if m < h.shape[1]:
                h = np.ascontiguousarray(h[:, :m])
            held.append(h), at.append(start[:m] + t)
            size += m
            if size > STATES:
                take()
                held, at, size = [], [], 0
            h = self.step(h, symbols[start[:m] + t])[0]
        if held:
            take()
        back = np.empty_like(out)
        back[order] = out
        return back


class Model:
    """What a task needs: counts of the commonest words, sums of classes and the network."""

    def __init__(self, total: int, distinct: int, unseen: float, once: int, sums: np.ndarray, head: tuple[np.ndarray, ...], read: np.ndarray):
        n, g, _ = _of(head, read)
        own = classes(read, n, g, total)
        #: the class of each symbol, and the counts of each class without the words that are read
        self.told = np.append(np.arange(N_CLASSES), own).astype(np.int16)
        self.rest = sums - np.bincount(own, n, minlength=N_CLASSES)
        network = Network(N_CLASSES, own, n / np.maximum(1, sums[own]))
        #: of each of the commonest words and of none: hash, count and what the network reads, or -1
        self.keys, self.counts = np.append(head[0], np.uint64(1)), np.append(head[1], 0)
        self.symbol = np.full(len(head[0]) + 1, -1)
        self.symbol[np.searchsorted(head[0], read)] = N_CLASSES + np.arange(len(read))
        slot, by = (head[0] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.argsort(head[1], kind="stable")
        self.slots, self.shared = np.full(1 << SLOT_BITS, -1, np.int32), np.zeros(1 << SLOT_BITS, bool)
        self.slots[slot[by]] = by
        self.shared[slot[self.slots[slot] != np.arange(len(slot))]] = True
        self.total, self.distinct, self.unseen, self.once, self.sums, self.head, self.read, self.network = total, distinct, unseen, once, sums, head, read, network
        #: and what a token of each of them adds to the base, its symbol and its share of that
        self.known = tuple(np.append(x, x.dtype.type(0)) for x in self.tokens(head[0], head[1], head[2], np.arange(len(head[0]))))

    def tokens(self, h: np.ndarray, n: np.ndarray, g: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 P of the base, the symbol that the network reads and log10 P(token | symbol) of words by hash, count, group and place among the commonest."""
        c = classes(np.where(h == END_KEY, END, h), n, g, self.total)
        symbols = self.symbols(k, c)
        return np.log10((n + 1) / (self.total + self.distinct + 1)), symbols.astype(np.uint16), self.within(n, c, symbols)

    def within(self, n: np.ndarray, c: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log10 P(token | symbol): of words that aren't read, among those of their class."""
        out = np.log10(np.maximum(n, 1)) - np.log10(np.maximum(self.rest[c], 1))
        out[c == RARE] = np.log10((1 - self.unseen) / max(1, self.once)) if self.once else -300.0
        out[n == 0] = np.log10(self.unseen)
        out[symbols >= N_CLASSES] = 0
        return out

    def look(self, h: np.ndarray) -> np.ndarray:
        """Places among the commonest words, or -1: one probe by the upper bits of the hash, and a search for the few words that share them."""
        slot = h >> np.uint64(64 - SLOT_BITS)
        k = self.slots[slot]
        hit = self.keys[k] == h
        out = np.where(hit, k, -1)
        may = np.flatnonzero(~hit & self.shared[slot])
        if len(may):
            x = np.searchsorted(self.head[0], h[may])
            x[x == len(self.head[0])] = 0
            out[may] = np.where(self.head[0][x] == h[may], x, -1)
        return out

    def symbols(self, k: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What the network reads, from places among the commonest words and classes."""
        own = self.symbol[k]
        return np.where(own >= 0, own, c)


def _of(table: tuple[np.ndarray, ...], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and groups of hashes from a table sorted by hash, and which are in it."""
    if not len(table[0]):
        return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    k = np.searchsorted(table[0], h)
    k[k == len(table[0])] = 0
    there = table[0][k] == h
    return np.where(there, table[1][k], 0), np.where(there, table[2][k].astype(np.int64), 0), there


ASK, REPLY = 1, 0


def _ask(model, buckets: int):
    """For each bucket of documents, the distinct words in it whose counts weren't broadcast, dealt by bucket of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value

        def rows() -> Iterator[tuple[int, int, bytes]]:
            held, size = [], 0

            def flush() -> Iterator[tuple[int, int, bytes]]:
                h, b = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((h, b))
                h, b = h[order], b[order]
                new = np.append(True, (h[1:] != h[:-1]) | (b[1:] != b[:-1])) if len(h) else np.zeros(0, bool)
                yield from _dealt(ASK, mix(h[new]) % np.uint64(buckets), [h[new], b[new]], ("u8", "u4"))

            for batch in batches:
                ids = batch.column(0).fill_null(0).to_numpy()
                data, off = utf8(batch.column(1))
                for i, j in chunks(off):
                    h, at = token_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    h &= ~np.uint64(15)
                    marks = np.array([text_mark(data[off[x] : off[x + 1]].tobytes()) for x in range(i, j)], np.uint16)
                    b = np.repeat(doc_bucket(ids[i:j], marks, buckets), np.diff(at))
                    far = (m.look(h) < 0) & (h != END_KEY)
                    h, b = h[far], b[far]
                    _, one = np.unique(h ^ mix(b.astype(np.uint64) + np.uint64(1)), return_index=True)
                    held.append((h[one], b[one]))
                    size += len(one)
                    if size > HELD:
                        yield from flush()
                        held, size = [], 0
            if held:
                yield from flush()

        yield from _rows(rows())

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known of the words asked for, by bucket of documents."""

    def rows() -> Iterator[tuple[int, int, bytes]]:
        for t in runs(batches, ["bucket"]):
            kinds, blobs = t.column("kind").to_numpy(), t.column("blob").to_pylist()
            table = unpack([b for k, b in zip(kinds, blobs, strict=True) if k == 0], _KINDS)
            h, b = unpack([x for k, x in zip(kinds, blobs, strict=True) if k == ASK], ("u8", "u4"))
            n, g, there = _of(tuple(table), h)
            yield from _dealt(REPLY, b[there].astype(np.int64), [h[there], n[there], g[there]], _KINDS)

    yield from _rows(rows())


def _read(model):
    """Of each text, what its counts tell and the symbols that the network reads, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        squeeze, small = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)

        def done(held: list[tuple], table: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(x for _, x, _ in held), np.uint8)
            h, off = token_hashes(data, np.cumsum([0, *(len(x) for _, x, _ in held)]))
            h &= ~np.uint64(15)
            k = m.look(h)
            n, (base, symbols, within), far = m.counts[k], (x[k] for x in m.known), np.flatnonzero(k < 0)
            n[far], g, _ = _of(table, h[far])
            base[far], symbols[far], within[far] = m.tokens(h[far], n[far], g, k[far])
            row_sum = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every row has an end
            base, within = row_sum(base), row_sum(within)
            blobs = [small.compress(symbols[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([i for i, *_ in held], pa.int64()), pa.array([t for _, _, t in held], pa.bool_()), pa.array(np.diff(off)), pa.array(row_sum((n > 0).astype(np.int64))), pa.array(base), pa.array(within), pa.array(blobs, pa.binary())], [x.split()[0] for x in READ_ROWS.split(", ")])

        bucket, blobs, table, held, size = None, [], None, [], 0
        for batch in batches:
            for b, k, blob, i, training in zip(*(batch.column(x).to_pylist() for x in range(5)), strict=True):
                if b != bucket:
                    if held:
                        yield done(held, table)
                    bucket, blobs, table, held, size = b, [], None, [], 0
                if k == REPLY:
                    blobs.append(blob)
                    continue
                if table is None:
                    t = unpack(blobs, _KINDS)
                    order = np.argsort(t[0])
                    table, blobs = tuple(x[order] for x in t), []
                held.append((i, squeeze.decompress(blob), training))
                size += len(held[-1][1])
                if size > SCORED_BYTES:
                    yield done(held, table)
                    held, size = [], 0
        if held:
            yield done(held, table)
        give_back()

    return run


READ_ROWS = "id long, training boolean, n_tokens long, n_known long, base_score double, within double, symbols binary"


def segments(symbols: np.ndarray, told: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A document's parts that are trained on, each from a zero state."""
    return [(symbols[i : i + SEGMENT], told[i : i + SEGMENT]) for i in range(0, len(told), SEGMENT)]


def _trained(model, number: int):
    """The weights after the task's training documents of a round, times their tokens, and the tokens; each document is trained on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        net = copy.deepcopy(m.network)
        squeeze, adam, rng = zstandard.ZstdDecompressor(), Adam(net.w), np.random.default_rng(number)
        held, size, tokens = [], 0, 0
        rate = ROUND_RATE * 0.6**number
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = np.frombuffer(squeeze.decompress(blob), np.uint16)
                held += segments(x, m.told[x])
                size, tokens = size + len(x), tokens + len(x)
                if size > ROUND_TOKENS:
                    net.passed(held, adam, rng, WINDOW, ROUND_BATCH, rate)
                    held, size = [], 0
        if held:
            net.passed(held, adam, rng, WINDOW, ROUND_BATCH, rate)
        if tokens:
            flat = np.concatenate([net.w[k].reshape(-1) for k in sorted(net.w)]).astype(np.float64) * tokens
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["tokens", "w"])
        give_back()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, total = 0, None
    for batch in batches:
        for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = np.frombuffer(w)
            tokens, total = tokens + n, w if total is None else total + w
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["tokens", "w"])


def _train_on_all(read: DataFrame, model: Model) -> int:
    """Trains the model's network on all training rows in rounds; returns the tokens trained on."""
    spark, seen = read.sparkSession, 0
    for number in range(ROUNDS):
        own = read.where("training").where(F.pmod(F.xxhash64("id", "symbols"), F.lit(ROUNDS)) == number).select("symbols")
        shared = spark.sparkContext.broadcast(model)
        got = own.mapInArrow(_trained(shared, number), "tokens long, w binary").repartition(8).mapInArrow(_summed, "tokens long, w binary").collect()
        n = sum(r.tokens for r in got)
        if n:
            flat, at = sum(np.frombuffer(r.w) for r in got) / n, 0
            for k in sorted(model.network.w):
                v = model.network.w[k]
                model.network.w[k] = flat[at : at + v.size].reshape(v.shape).astype(v.dtype)
                at += v.size
        seen += n
    return seen


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            off = np.append(0, np.cumsum(batch.column(1).to_numpy()))
            for i, j in chunks(off, SCORED_TOKENS):
                symbols = np.frombuffer(b"".join(squeeze.decompress(x) for x in batch.column(5).slice(i, j - i).to_pylist()), np.uint16)
                score = batch.column(4).slice(i, j - i).to_numpy() + m.network.scores(symbols, m.told[symbols], off[i : j + 1] - off[i]) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(i, j - i) for x in range(4)), pa.array(score)], ["id", "n_tokens", "n_known", "base_score", "score"])
        give_back()

    return run


#: The end's hash as it is kept in tables, whose lowest four bits are cut off.
END_KEY = END & ~np.uint64(15)


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", training: F.Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    training: which rows of docs to learn from. Texts are lower-cased (A-Z) and cut at ASCII white space; null texts are empty and are an end alone. Words are told apart by 60-bit hashes.
    Without any training rows every token is unseen: its count is 0 and the network is as it began. Repeated rows and rows without an id are scored each; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "model")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(training if training is not None else F.lit(True), F.lit(False)).alias("training"))
    learn = rows.where("training").select("id", "text")
    size, own, many = rows.agg(F.sum(F.octet_length("text")), F.sum(F.when(F.col("training"), F.octet_length("text"))), F.count_if("training")).first()
    size, own = size or 0, own or 0
    buckets = max(parts(spark), -(-int(size) // BUCKET_BYTES))
    met = lambda df: df.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")

    # a sample by a threshold of the hash, which is a plain filter: whole documents, about as many as the bounds let in
    sample, tokens, length = [], 0, F.coalesce(F.octet_length("text"), F.lit(0))
    share = min(1.0, GROUP_DOCS / max(1, many), GROUP_BYTES / max(1, own))
    drawn = F.col("training") & (F.pmod(F.xxhash64("id", length), F.lit(1 << 30)) < int(share * (1 << 30)))
    for r in sorted(rows.where(drawn & (length <= GROUP_LONGEST)).select("id", "text").collect(), key=lambda r: (zlib.crc32(str(r.id).encode()), str(r.id), r.text or "")):
        b = np.frombuffer((r.text or "").encode(), np.uint8)
        sample.append(token_hashes(b, np.array([0, len(b)]))[0])
    signs, centres = _fit_groups(sample)
    signed = scratch.cut(learn.select("text").mapInArrow(_signed(signs), SIGN_ROWS), "signs") if len(signs) else None
    for _ in range(MOVES if len(signs) else 0):
        moved = signed.mapInArrow(_moves(centres), "g long, n double, sums array<double>").collect()  # a row of each group from each task
        sums, n = np.zeros(centres.shape), np.zeros(len(centres))
        for r in moved:
            sums[r.g] += r.sums
            n[r.g] += r.n
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    if signed is not None:
        scratch.drop(signed)

    table = scratch.cut(met(learn.select("text").mapInArrow(_count(signs, centres, buckets), ROWS)).mapInArrow(_table, ROWS), "words")
    steps = table.mapInArrow(_numbers, "step long, words long, tokens long").groupBy("step").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).orderBy(F.desc("step")).collect()
    total, distinct = sum(r.tokens for r in steps), sum(r.words for r in steps)
    number = {r.step: r.words for r in steps}
    once, twice = number.get(1, 0), number.get(2, 0)
    least, so_far = 2**62, 0
    for r in steps:
        so_far += r.words
        if so_far > HEAD:
            break
        least = r.step if r.step <= 64 else int(64 * 2 ** ((r.step - 65) / 2)) + 1
    collected = lambda f: sorted((np.uint64(r.h & 0xFFFFFFFFFFFFFFFF), r.n, r.g) for r in table.mapInArrow(f, "h long, n long, g long").collect())
    as_table = lambda got: (np.array([x for x, _, _ in got], np.uint64), np.array([x for _, x, _ in got], np.int64), np.array([x for _, _, x in got], np.int64))
    head = as_table(collected(_matching(None, least)))
    sums = np.zeros(N_CLASSES)
    for r in table.mapInArrow(_by_class(total), "c long, tokens long").groupBy("c").agg(F.sum("tokens").alias("n")).collect():
        sums[r.c] = r.n
    # the end has a class of its own, and words seen once are one with unseen ones
    may = np.flatnonzero((head[1] > 1) & (head[0] != END_KEY))
    common = np.sort(head[0][may[np.argsort(-head[1][may], kind="stable")[:READ]]])
    model = Model(total, distinct, (once + 1) / (once + 2 * twice + 2), once, sums, head, common)

    chosen = []
    for d in sample[:TRAIN_DOCS]:
        if tokens + len(d) <= TRAIN_TOKENS:
            chosen.append(d & ~np.uint64(15))
            tokens += len(d)
    if chosen and total:
        wanted = np.unique(np.concatenate(chosen))
        known = as_table(collected(_matching(wanted, 0)))
        streams = []
        for h in chosen:
            n, g, _ = _of(known, h)
            c = classes(np.where(h == END_KEY, END, h), n, g, total)
            streams += segments(model.symbols(model.look(h), c), c)
        model.network.train(streams)
    shared = spark.sparkContext.broadcast(model)

    texts = rows.select("id", "text", "training").mapInArrow(_send_texts(buckets), ROWS + ", id long, training boolean")
    asked = rows.select("id", "text").mapInArrow(_ask(shared, buckets), ROWS)
    replies = met(table.unionByName(asked)).mapInArrow(_answer, ROWS)
    both = met(texts.unionByName(replies.select("bucket", "kind", "blob", F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("training"))))
    read = scratch.cut(both.mapInArrow(_read(shared), READ_ROWS), "symbols")
    if total:
        _train_on_all(read, model)
    trained = spark.sparkContext.broadcast(model)
    out = read.select("id", "n_tokens", "n_known", "base_score", "within", "symbols").mapInArrow(_score(trained), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

"""Hashes of words and spans; toxicity against a plain version over all words."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from vigilspark.llm import entries, toxicity
from vigilspark.llm.minhash import near_duplicates, shingle_sets
from vigilspark.llm.shared import BLANK_WORD, Spans, word_hashes, words

#: A word of 1024 bytes and its mirror whose polynomials modulo 2**64 are equal for every odd base.
MORSE = bytes(97 + i.bit_count() % 2 for i in range(1024))
MIRROR = bytes(195 - c for c in MORSE)


def test_words_whose_polynomials_agree_are_told_apart(spark):
    two = np.frombuffer(MORSE + b" " + MIRROR, np.uint8)
    s, e = np.array([0, 1025]), np.array([1024, 2049])
    assert len(set(word_hashes(two, s, e).tolist())) == len(set(Spans(two).of(s, e).tolist())) == 2
    a, b = shingle_sets(two, np.array([0, 1025, 2049]))
    assert set(a.tolist()) != set(b.tolist())
    texts = [MORSE.decode(), MIRROR.decode(), MORSE.decode()]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 1), (2, 0)}


def test_word_hashes_tell_words_apart_wherever_they_are():
    r = np.random.default_rng(5)
    text = b" ".join(bytes(r.integers(97, 100, n).astype(np.uint8)) for n in [*r.integers(1, 20, 5000), 255, 256, 257, 4000, 8, 16, 24])
    buf = np.frombuffer(text + b" " + text, np.uint8)
    s, e, _ = words(buf, np.array([0, len(buf)]), BLANK_WORD)
    h = word_hashes(buf, s, e).tolist()
    own = [buf[a:b].tobytes() for a, b in zip(s, e, strict=True)]
    assert len(set(h)) == len(set(own)) == len(set(zip(h, own, strict=True)))
    assert not len(word_hashes(buf, s[:0], e[:0]))
    spans = Spans(buf)
    a = r.integers(0, len(buf) - 300, 2000)
    n = r.integers(1, 300, 2000)
    strings = [buf[x : x + k].tobytes() for x, k in zip(a, n, strict=True)]
    assert len(set(zip(spans.of(a, a + n).tolist(), strings, strict=True))) == len(set(strings)) == len(set(spans.of(a, a + n).tolist()))


def plain_scores(texts, examples):
    """texts: {id: text}, examples: {id: label}. {id: (sum of the neighbours' votes, sorted cosines, evidence)} by dense cosines."""
    cut = lambda t: Counter(re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower()))
    docs = {i: cut(t) for i, t in texts.items()}
    df = Counter(w for d in docs.values() for w in d)
    sizes = [sum(y == c for y in examples.values()) for c in (0, 1)]
    held = {w: [0, 0] for i in examples for w in docs[i]}
    for i, y in examples.items():
        for w in docs[i]:
            held[w][y] += 1
    weight = {}
    for w, (n0, n1) in held.items():
        a, b = n1 + 0.5, n0 + 0.5
        sure = abs(math.log(a / (sizes[1] + 1) / (b / (sizes[0] + 1)))) / math.sqrt(1 / a + 1 / b)
        weight[w] = math.log((2 + len(texts)) / (1 + df[w])) * max(sure, toxicity.FLOOR) ** toxicity.RELEVANCE

    def unit(d):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in d.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    units = {i: unit(docs[i]) for i in docs}
    out = {}
    for i, v in units.items():
        c = {e: sum(x * units[e].get(w, 0.0) for w, x in v.items()) for e in examples}
        out[i] = sorted(((x, e) for e, x in c.items() if x > 0), reverse=True)[: toxicity.NEIGHBOURS]
    return out


@pytest.mark.parametrize("sf", ["0.001"])
def test_toxicity_query_equals_dense_cosines(spark, sf):
    at = f"/root/testdata/sf{sf}"
    texts = dict(zip(*pq.read_table(f"{at}/documents.parquet").select(["doc_id", "text"]).to_pydict().values(), strict=True))
    labels = pq.read_table(f"{at}/labels.parquet").to_pylist()
    examples = {r["doc_id"]: r["toxic"] for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    got = {r.doc_id: r for r in entries.op1_toxicity(spark, at).collect()}
    want = plain_scores(texts, examples)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fitted(docs, entries.training_labels(spark.read.parquet(f"{at}/labels.parquet")))
    assert sorted(model.index.ids) == sorted(examples)
    for i, near in want.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)
        if not near:
            assert got[i].evidence == [] and got[i].score == model.alone
            continue
        votes = [c / (1.05 - min(c, 1)) for c, _ in near]
        v = sum(x * examples[e] for x, (_, e) in zip(votes, near, strict=True)) / sum(votes)
        least = near[min(3, len(near)) - 1][0]
        assert {e for c, e in near if c > least + 1e-9} <= set(got[i].evidence) <= {e for c, e in near if c >= least - 1e-9} | {e for e in examples if e in got[i].evidence and len(near) > 3 and abs(near[3][0] - least) < 1e-9}
        # ties at the last of the neighbours may be broken either way
        if len(near) < toxicity.NEIGHBOURS or near[-1][0] < near[-2][0] - 1e-9:
            assert got[i].score == pytest.approx(model.score(v), abs=1e-6)
    assert sum(not near for near in want.values()) < 0.05 * len(want)


@pytest.mark.parametrize("block", [8, 16])
def test_large_groups_that_hold_together_or_not(spark, monkeypatch, block):
    """Candidate groups of many blocks: one chain of copies, one of which pivots don't reach all members, one whose members aren't linked."""
    from vigilspark.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    monkeypatch.setattr(minhash, "WIDE", 4)
    r = np.random.default_rng(12)
    base = [f"w{k}" for k in r.integers(0, 900, 120)]
    texts = [" ".join(w if k != v else f"x{v}" for k, w in enumerate(base)) for v in range(60)]
    # each differs from the last by one more word, so that only neighbours are linked
    chain, now = [], [f"c{k}" for k in r.integers(0, 900, 90)]
    for v in range(70):
        now = [f"y{v}" if k == v else w for k, w in enumerate(now)]
        chain.append(" ".join(now))
    # a shared half: candidates now and then, links never
    half = [f"h{k}" for k in r.integers(0, 900, 60)]
    loose = [" ".join(half + [f"z{v}a{k}" for k in range(14)]) for v in range(40)]
    rows = list(enumerate(texts + chain + loose))
    from . import brute

    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    want, _ = brute.near([i for i, _ in rows], [t for _, t in rows], 80)
    assert {r.doc_id: r.component_id for r in got} == want


def test_vectors_of_many_tiles_and_pivots(spark, monkeypatch):
    from vigilspark.llm import vectors

    from . import brute

    monkeypatch.setattr(vectors, "TILE", 8)
    monkeypatch.setattr(vectors, "ROOTS", 0.5)
    r = np.random.default_rng(4)
    hubs = r.normal(size=(6, 12))
    v = [(hubs[k % 6] + 0.2 * r.normal(size=12)).astype(np.float32).tolist() for k in range(150)] + [r.normal(size=12).astype(np.float32).tolist() for _ in range(60)]
    v += v[:5] * 3 + [r.normal(size=5).astype(np.float32).tolist() for _ in range(9)]
    rows = list(enumerate(v)) + [(3, v[3]), (7, v[9])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    links = [(i, j) for i in range(len(v)) for j in range(i) if len(v[i]) == len(v[j]) and brute.cosine(v[i], v[j]) >= 0.9]
    links += [(7, 9)]
    want = brute.components(range(len(v)), links)
    assert {(r.vec_id, r.component_id) for r in got} == set(want.items()) and len(got) == len(rows)


def test_vectors_are_not_shuffled_to_their_partners(spark, monkeypatch):
    from vigilspark.llm import vectors

    from . import brute

    monkeypatch.setattr(vectors, "TILE", 32)
    monkeypatch.setattr(vectors, "BLOCK", 60_000, raising=False)
    r = np.random.default_rng(5)
    v = r.normal(size=(1000, 64)).astype(np.float32)
    v = np.concatenate([v, v[:200] + 0.1 * r.normal(size=(200, 64)).astype(np.float32), v[:20], -0.0 * v[:1]])
    v[3, 5], v[1203, 5] = 0.0, -0.0
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def shuffled() -> int:
        bus.waitUntilEmpty()
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = shuffled()
    got = vectors.near_vectors(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>")).collect()
    assert shuffled() - before < 4 * v.nbytes
    links = [(i, j) for i, j in zip(*np.nonzero(np.tril(vectors.units(v[:-1]) @ vectors.units(v[:-1]).T >= 0.89, -1)), strict=True) if brute.cosine(v[i].tolist(), v[j].tolist()) >= 0.9]
    want, count = brute.components(range(len(v)), links), np.bincount(np.array(links).ravel(), minlength=len(v))
    assert len(links) > 200
    assert {(x.vec_id, x.n_links, x.component_id) for x in got} == {(i, count[i], want[i]) for i in want} and len(got) == len(v)


def test_contamination_of_very_long_texts_and_repeated_rows(spark, monkeypatch):
    from vigilspark.llm import decontaminate

    r = np.random.default_rng(3)
    words = lambda n, kind: [f"{kind}{k}" for k in r.integers(0, 50_000, n)]
    items = [(i, " ".join(words(40, "b"))) for i in range(60)] + [(60, "solo"), (60, None)]
    long = words(200_000, "d")
    long[1000:1040], long[150_000:150_013], long[-1:] = items[3][1].split(), items[7][1].split()[5:18], ["SOLO"]
    rows = [(0, " ".join(long)), (1, items[5][1].upper()), (1, items[5][1].upper()), (2, " ".join(items[9][1].split()[:12])), (None, "solo")]
    want = [(None, 1, 1, ["60"]), (0, 200_000, 54, ["3", "60", "7"]), (1, 40, 40, ["5"]), (1, 40, 40, ["5"]), (2, 12, 0, [])]
    for size in (decontaminate.BLOCK_BYTES, 500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted(((x.id, x.n_words, x.n_hit, x.items) for x in got), key=lambda x: (x[0] is not None, x[0] or 0)) == want

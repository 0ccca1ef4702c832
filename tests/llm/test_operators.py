import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilspark.llm import entries, toxicity
from vigilspark.llm.components import connected_components
from vigilspark.llm.decontaminate import contamination, window_index
from vigilspark.llm.html_text import extracted, main_text
from vigilspark.llm.language_model import Network
from vigilspark.llm.language_model import scored as model_scored
from vigilspark.llm.licenses import scanned
from vigilspark.llm.minhash import near_duplicates
from vigilspark.llm.packing import ChunkTokens, best_fit, configurations, packed, priced, solved
from vigilspark.llm.repeats import repeated_bytes
from vigilspark.llm.shared import Scratch
from vigilspark.llm.toxicity import BlockMax, fitted, scored
from vigilspark.llm.vectors import likely, near_vectors, quantised, units
from vigilspark.llm.warc import derivatives, derivatives_of_files, derived, digest, files, record, records, response

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket string, kind int"


def rng_text(seed, n, vocabulary=40):
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in r.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    base = rng_text(1, 120, 400)
    words = base.split()
    near = [" ".join(w if k % 40 else f"x{v}" for k, w in enumerate(words)) for v in range(4)]
    far = [" ".join(w if k % 6 else f"y{v}" for k, w in enumerate(words)) for v in range(3)]
    long = " ".join(rng_text(s, 3000, 5000) for s in range(6))
    texts = [base, base, None, "", "one", "one", "a b c", *near, *far, "é" * 300, "é" * 300, "aaaa" * 100, long, long[500:9000], base.upper(), "tail " + base[:150], " \t\n"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those that operators use, null columns and a row without an id."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), None, "b", 9) for i, t in rows] + [(None, rows[0][1], None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(docs, rows, percent):
    got = near_duplicates(docs, percent=percent).collect()
    want, n = brute.near([i for i, _ in rows], [t for _, t in rows], percent)
    assert {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in got if r.doc_id is not None} == {(i, want[i], n[i], want[i] == i) for i in want}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_duplicates_of_a_wide_bucket(spark):
    words = rng_text(3, 200, 900).split()
    texts = [" ".join(w if k != v % 190 else f"z{v}" for k, w in enumerate(words)) for v in range(700)]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=85).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 700


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (500, 501), (501, 500), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 500: 500, 501: 500}


def test_repeats_equal_brute_force(docs, rows):
    got = {r.id: r for r in repeated_bytes(docs).collect()}
    want = brute.repeats(rows)
    for i, w in want.items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w[:4], i
    assert got[None].n_removed == 0


def test_repeats_of_a_hot_passage_and_repeated_rows(spark):
    passage = rng_text(9, 60, 500)
    rows = [(i, f"{rng_text(100 + i, 30, 3000)} {passage} {rng_text(900 + i, 30, 3000)}") for i in range(250)]
    got = {r.id: r for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    want = brute.repeats(rows)
    assert all((got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w[:4] for i, w in want.items())
    twice = repeated_bytes(spark.createDataFrame([rows[0], rows[0]], "doc_id long, text string")).collect()
    assert [r.n_removed for r in twice] == [0, 0]


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (10, "short item"), (2, None), (3, ""), (None, "no id here"), (4, "short item"), (5, "!!")]


def test_contamination_equals_brute_force(spark):
    texts = ["", None, "short item", "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen y", "SHORT, item; short", "two three four five six seven eight nine ten eleven twelve thirteen", "no id here", "short" + "\n" * 9 + "item"]
    got = contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    for r in got:
        n, hit, items = brute.hits(texts[r.id], [x for x in ITEMS if x[0] is not None])
        if r.id != 6:
            assert (r.n_words, r.n_hit, r.items) == (n, hit, items), r.id
    assert [(r.n_hit, r.items) for r in got if r.id == 6] == [(3, [])]
    r = next(r for r in got if r.id == 3)
    assert texts[3].encode()[r.starts[0] : r.ends[0]].decode() == ITEMS[0][1].lower()


def test_a_large_benchmark_is_scanned_in_blocks(spark, monkeypatch):
    import vigilspark.llm.decontaminate as d

    docs = spark.createDataFrame([(0, "short item and one two three four five six seven eight nine ten eleven twelve thirteen")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = contamination(docs, bench).collect()
    monkeypatch.setattr(d, "BLOCK_BYTES", 40)
    assert contamination(docs, bench).collect() == whole
    assert not window_index([("1", None)], 13)["lengths"]


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(4)
    v = [r.normal(size=16).astype(np.float32).tolist() for _ in range(60)]
    v += [(np.array(v[i]) + 0.12 * r.normal(size=16)).astype(np.float32).tolist() for i in range(30)] + [v[0], v[0]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0], [float("inf")] * 16]
    rows = [(i, x, 1, "k", 2) for i, x in enumerate(v + odd)] + [(None, v[0], 1, "k", 2)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, pair string, n int")).collect()
    links = [(i, j) for i in range(len(v)) for j in range(i) if brute.cosine(v[i], v[j]) >= 0.9]
    want = brute.components(range(len(v) + len(odd)), links)
    count = np.bincount(np.array(links).ravel(), minlength=len(want))
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {(i, count[i], want[i], want[i] == i) for i in want}


def test_quantisation_bounds_lose_no_pair():
    r = np.random.default_rng(8)
    a = units(r.normal(size=(300, 32)) * np.exp(r.normal(size=(300, 32))))
    b = units(a + 0.3 * r.normal(size=a.shape) * np.abs(a))
    for threshold in (0.5, 0.9, 0.95):
        want = {(i, j) for i, j in zip(*np.nonzero(a @ b.T >= threshold), strict=True)}
        assert want <= set(zip(*likely(quantised(a), quantised(b), threshold), strict=True))


PAGE = '<html><head><title>t</title></head><body><header>top</header><nav><ul><li><a href="/">menu</a></li></ul></nav><div class="cookie-notice">cookies</div><div id="content"><h1>Head &amp; line</h1><p>{long}</p><p>Short.<br>More</p></div><aside>side</aside><div class="comments"><p>{long}</p></div><script>var x="</p>";</script><form>q</form><footer>foot</footer></body></html>'


def test_main_text():
    long = "Words of the article that go on for a while, " * 6
    assert main_text(PAGE.format(long=long)) == "Head & line\n\n" + long.strip() + "\n\nShort. More"
    assert main_text(None) == main_text("") == main_text("<script>x") == ""
    assert main_text("plain  text\n here") == "plain text here"
    assert main_text("<![odd[ <p>x") and main_text("<p>a<p>b<div><b>c") == "a\n\nb\n\nc"
    assert main_text("<article><p>x</p>" * 300).count("x") == 300


def test_pages(spark, none):
    t = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pydict()
    got = {r.page_id: r for r in entries.op5_html(spark, "/root/testdata/sf0.01").collect()}
    assert all(got[i].text == main_text(h) and got[i].n_chars == len(got[i].text) for i, h in zip(t["page_id"], t["html"], strict=True))
    odd = spark.createDataFrame([(1, None, None, "x"), (None, None, "<p>a</p>", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in extracted(odd, carry=["url"]).collect()) == [("1", "", 0), ("1", "", 0), ("None", "a", 1)]


def test_warc_round_trip(spark, tmp_path):
    made = [response(f"http://x/{i}", f"<p>é{i}</p>", "2020-01-01T00:00:00Z") for i in range(5)] + [response(None, None, "")]
    data = b"".join(record(*m) for m in made)
    assert list(records(data)) == made and derived([("WARC-Type", "request")], b"") == []
    (tmp_path / "a.warc").write_bytes(data)
    rows = derivatives_of_files(spark, str(tmp_path))
    got = rows.collect()
    source = {dict(h)["WARC-Record-ID"]: (dict(h), b) for h, b in made}
    assert len(got) == 12 and {r.refers_to for r in got} == set(source)
    for r in got:
        h, _ = source[r.refers_to]
        assert r.source_payload_digest == h["WARC-Payload-Digest"] and r.source_block_digest == h["WARC-Block-Digest"]
        assert r.block_digest == digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.warc_type == "conversion" or "source-warc-record-id: " + r.refers_to in r.block
    assert {r.block for r in got if r.warc_type == "conversion"} == {*(f"é{i}" for i in range(5)), ""}
    members = b"".join(r.member for r in files(rows).collect())
    back = list(records(members))
    assert {(dict(h)["WARC-Record-ID"], b) for h, b in back} == {(r.record_id, r.block.encode()) for r in got}


def test_conversions_keep_the_whole_text():
    page = "<html><head><title>T</title><style>s{}</style><script>x()</script></head><body class='widget'><nav><a>menu</a></nav><form><p>in form</p><button>go</button></form><div class='ad comment'>said</div><!-- no --><template><p>t</p></template><footer>foot</footer></body></html>"
    (_, _), (headers, block) = derived(*response("http://x", page, "2020-01-01T00:00:00Z"))
    assert block.decode().split() == ["T", "menu", "in", "form", "go", "said", "foot"] and dict(headers)["WARC-Block-Digest"] == digest(block)


def test_warc_query_links_both_records(spark):
    got = entries.op8_warc(spark, "/root/testdata/sf0.001").collect()
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")
    assert len(got) == 2 * pages.num_rows and len({r.record_id for r in got}) == len(got)
    odd = derivatives(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).collect()
    assert [r.warc_type for r in odd] == ["metadata", "conversion"]


def test_plans_hold_each_item_once_and_fit():
    r = np.random.default_rng(2)
    for trial in range(20):
        lengths = np.unique(r.integers(1, 101, r.integers(1, 30)))
        counts = r.integers(1, 200 if trial % 2 else 3, len(lengths))
        for plan in (configurations(lengths, counts, 100), best_fit(lengths, counts, 100)):
            held = {}
            for times, config in plan:
                assert times > 0 and sum(n * k for n, k in config) <= 100
                for n, k in config:
                    held[n] = held.get(n, 0) + times * k
            assert held == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    assert priced(np.array([3, 5, 7]), np.array([3.0, 5.2, 7.1]), 10)[[2, 4, 9, 10]] == pytest.approx([0, 3.0, 9.0, 10.4])


def test_the_program_places_most_items_near_its_bound():
    r = np.random.default_rng(6)
    lengths, counts = np.unique(np.minimum(4095, r.gamma(1.2, 700, 4000).astype(int) + 1), return_counts=True)
    for times in (1, 50):
        many = counts * times
        plan, rest, bound = solved(lengths, many, 4096)
        assert (rest * lengths).sum() < 0.1 * (many * lengths).sum()
        assert bound == pytest.approx((many * lengths).sum() / 4096, rel=0.01)
        total = sum(n for n, _ in configurations(lengths, many))
        assert bound <= total + 1e-6 and total <= max(bound * 1.002, bound + 2) and total <= sum(n for n, _ in best_fit(lengths, many, 4096))
    # where best fit is far from the bound the program saves sequences
    lengths, counts = np.unique(r.integers(1024, 2049, 20000), return_counts=True)
    assert sum(n for n, _ in configurations(lengths, counts)) < 0.98 * sum(n for n, _ in best_fit(lengths, counts, 4096))


def test_packed_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(entries.tokenizer_path("word_bpe_49k.json"))
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    want = {}
    for i, text in zip(t["doc_id"], t["text"], strict=True):
        ids = np.array([*real.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    got = entries.op9_packing(spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def test_chunked_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = entries.tokenizer_path("word_bpe_49k.json")
    texts = ["Hello, World!! it's  DON'T 3.14", "", "é,è. Ñ;x ÷, ×.", "<|ENDOFTEXT|>, <|endoftext|>!", "a b c.", "ß? İ! ﬁ.x", "x" * 5000, " \n\t", "!?.,;:", "one. Two.Three"]
    own, real = ChunkTokens(path), Tokenizer.from_file(path)
    data = [t.encode() for t in texts]
    ids, at = own(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 1)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*real.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_packing(spark, docs, none):
    got = packed(docs.unionByName(docs), entries.tokenizer_path("word_bpe_49k.json")).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len({r.doc_id for r in got}) == len({r.doc_id for r in docs.collect()})
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packed(none, entries.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_model_base_scores_and_probabilities(spark, docs, rows, none):
    train = (F.col("doc_id") % 3 != 0)
    got = {r.id: r for r in model_scored(docs, training=train).collect()}
    want = brute.base_scores([t for _, t in rows], [i % 3 != 0 for i, _ in rows])
    for (i, _), (n, known, total, base) in zip(rows, want, strict=True):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    assert model_scored(none).count() == 0
    assert model_scored(docs, training=F.lit(False)).count() == len(rows) + 1


def test_network_trains_on_all_documents(spark, monkeypatch):
    from vigilspark.llm import language_model

    seen, own = [], language_model._train_on_all
    monkeypatch.setattr(language_model, "_train_on_all", lambda *a: seen.append(own(*a)))
    # the sample's bound lets no document in; one document is longer than it
    monkeypatch.setattr(language_model, "TRAIN_TOKENS", 50)
    docs = spark.createDataFrame([(i, " ".join(["a b c d"] * (3000 if i == 7 else 20)) + f" x{i}") for i in range(90)], "doc_id long, text string")
    got = {r.id: r for r in model_scored(docs, training=F.col("doc_id") < 80).collect()}
    want = sum(got[i].n_tokens for i in range(80))
    assert seen == [want] == [got[0].train_tokens]
    # and learns from them
    monkeypatch.setattr(language_model, "ROUNDS", 0)
    less = {r.id: r.score for r in model_scored(docs, training=F.col("doc_id") < 80).collect()}
    assert all(got[i].score > less[i] for i in range(80, 90))


def test_the_end_counts_however_rare_it_is(spark, monkeypatch):
    from vigilspark.llm import language_model

    # fewer documents than the commonest words have tokens, and room for few words
    monkeypatch.setattr(language_model, "HEAD", 3)
    rows = [(i, f"a b c d e f{i} " * 30) for i in range(4)]
    got = {r.id: r for r in model_scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), (n, known, total, base) in zip(rows, brute.base_scores([t for _, t in rows], [True] * 4), strict=True):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)


def small_network():
    net = Network(5, np.array([2, 2, 3, 2]), np.array([0.5, 0.25, 1.0, 0.125]), units=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    net.w["v"] *= 30
    return net


def shares(y, e):
    assert np.allclose(np.exp(y), e)
    return e / e.sum(0)


def test_network_gradients_and_state():
    net = small_network()
    # symbols 0 to 4 are classes, 5 to 8 words of the classes 2, 2, 3 and 2
    xs, cs = np.array([[1, 0], [5, 8], [2, 7], [6, 0]]), np.array([[1, 0], [2, 2], [2, 3], [2, -1]])
    h = np.random.default_rng(1).normal(size=(4, 2)) * 0.1
    grads, _, loss, n = net._window(h, xs, cs)
    for name, at in (("x", (5, 5)), ("u", (1, 2)), ("o", (2, 3)), ("b", (1,)), ("v", (1, 6)), ("v", (2, 2)), ("v", (0, 7)), ("d", (8,))):
        eps = 1e-6
        net.w[name][at] += eps
        more = net._window(h, xs, cs)[2]
        net.w[name][at] -= eps
        assert (more - loss) / eps / n == pytest.approx(grads[name][at], abs=1e-4)
    symbols, told = np.array([1, 5, 2, 6, 1]), np.array([1, 2, 2, 2, 1])
    whole = net.scores(symbols, told, np.array([0, 4, 5]))
    assert whole[1] == pytest.approx(np.log(shares(*net.classes_of(np.zeros((4, 1))))[1, 0]), abs=1e-5) and whole[0] < whole[1] * 0.9
    assert whole[0] == pytest.approx(-net._window(np.zeros((4, 1)), symbols[:4, None], told[:4, None])[2], abs=1e-4)


def test_probabilities_sum_to_one_in_every_state():
    net = small_network()
    for h in np.random.default_rng(2).normal(size=(5, 4, 1)):
        c = shares(*net.classes_of(h))[:, 0]
        total = sum(p * (shares(*net.words_of(h, net.members[i])).sum() if i in net.members else 1) for i, p in enumerate(c))
        assert c.sum() == pytest.approx(1) and total == pytest.approx(1)
        # the state decides which word of a class comes
        assert not np.allclose(shares(*net.words_of(h, net.members[2])), shares(*net.words_of(h * 0, net.members[2])))
    # great weights don't overflow
    net.w["o"] *= 1e4
    assert np.isfinite(net.classes_of(h)[1]).all()
    # class 3 has no words but the one that is read
    assert net.members[3].tolist() == [7] and net.members[2].tolist() == [5, 6, 8, 2]


def test_model_probabilities_sum_to_one(spark):
    """All seen words and one unseen word, as one-word texts after the end: the sum of P(word) in the first state."""
    from vigilspark.llm import language_model

    train = [(i, " ".join(["a b c", "a a d", "e f a b", "g"][i % 4].split() + [f"h{i % 5}"])) for i in range(40)]
    seen = sorted({w for _, t in train for w in t.split()})
    docs = spark.createDataFrame(train + [(1000 + k, w) for k, w in enumerate([*seen, "unseen", ""])], "doc_id long, text string")
    got = {r.id: r for r in model_scored(docs, training=F.col("doc_id") < 1000).collect()}
    # a one-word text is that word and an end; whatever the word, what the end takes off is at most all
    words = sum(10 ** got[1000 + k].score for k in range(len(seen) + 1)) + 10 ** got[1000 + len(seen) + 1].score
    assert 0 < words < 1
    assert all(r.score < 0 for r in got.values()) and language_model.READ >= len(seen)


@pytest.mark.parametrize("common", [0, 5, 1024])
def test_block_max_search_is_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "QUERIES", 7)
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(50, r.integers(0, 9), replace=False)), None) for _ in range(300)]
    rows = [(t, w / max(1e-9, np.linalg.norm(w))) for t, w in ((t, r.random(len(t))) for t, _ in rows)]
    index = BlockMax(rows, r.integers(0, 2, 300), list(range(300)), 50)
    dense = np.zeros((300, 50))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for (t, w), (i, c) in zip(rows, index.nearest(rows, 7), strict=True):
        want = np.sort(dense[:, t] @ w)[::-1][:7] if len(t) else np.zeros(0)
        assert c == pytest.approx(want[want > 0]) and c == pytest.approx(dense[index.order[i]][:, t] @ w)
    place = np.argsort(index.order).tolist()
    assert all(p not in i for p, (i, _) in zip(place, index.nearest(rows, 7, place), strict=True))


def test_toxicity_learns_and_takes_odd_rows(spark, none):
    clean, toxic = [rng_text(i, 30, 60) for i in range(120)], [rng_text(500 + i, 30, 60) + " vile" * (1 + i % 3) for i in range(60)]
    rows = list(enumerate(clean + toxic)) + [(900, None), (901, ""), (None, "vile"), (902, "vile " * 20000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(0, 180, 2)] + [(3, None), (None, 1), (2, 0)], "id long, label int")
    got = {r.id: r.score for r in scored(docs, fitted(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i >= 120) for i in range(180)) and got[900] == got[901] < 0.5 and got[902] >= 0.5
    assert scored(none, fitted(none, labels)).count() == 0
    assert {r.score for r in scored(docs, fitted(docs, labels.where("label = 5"))).collect()} == {0.0}


def test_toxicity_learns_words_of_few_examples(spark):
    bad = ["vile", "grim", "foul", "base", "rank"]
    texts = [rng_text(i, 30, 60) for i in range(80)] + [rng_text(500 + i, 30, 60) + " " + bad[i % 5] for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 80)) for i in range(120) if i < 60 or 80 <= i < 100], "id long, label int")
    got = {r.id: r.score for r in scored(docs, fitted(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i >= 80) for i in range(120))


def test_held_out_toxicity(spark):
    got = entries.op1_toxicity(spark, "/root/testdata/sf0.1").where("held_out").select("doc_id", "predicted", "score")
    r = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert np.mean([x.predicted == x.toxic for x in r]) > 0.95 and all(0 <= x.score <= 1 for x in r)


def test_licences(spark, none):
    rows = [("r/LICENSE", "Released under the MIT License."), ("r/a/x.c", "int x;"), ("r/a/y.c", "intro\nLicensed under the Apache License, Version 2.0.\nmore"), ("s/z.c", "licensed things"), ("r/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("r/b/c/d.c", None), (None, "Released under the MIT License."), ("r/a/x.c", "int x;")]
    rows += [(f"t/{i}.c", rng_text(i, 20)) for i in range(60)]
    got = {}
    for r in scanned(spark.createDataFrame([(p, t, 1.0, "x") for p, t in rows], "path string, text string, dot double, f string"), carry=["dot"]).collect():
        got.setdefault(r.path, []).append((r.license, r.origin, r.license_path))
    assert got["r/LICENSE"] == [("MIT", "own", "r/LICENSE")] and got["r/a/x.c"] == [("MIT", "inherited", "r/LICENSE")] * 2
    assert got["r/a/y.c"] == [("Apache-2.0", "own", "r/a/y.c")] and got["r/b/c/d.c"] == [("GPL-3.0", "inherited", "r/b/COPYING")]
    assert got["s/z.c"] == [(None, "none", None)] and got[None] == [("MIT", "own", None)]
    assert scanned(none.withColumn("path", F.col("source"))).count() == 0


@pytest.mark.parametrize("plain", [0, 1, 5, 20])
def test_licences_that_many_files_hold(spark, plain):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    for held in lines if plain else lines[:1]:
        licensed = max(1, plain)
        rows = [(f"p{i}/x.c", f"{rng_text(i, 9)}\n{held}\nint x;") for i in range(licensed)] + [(f"q{i}/y.c", rng_text(70 + i, 9)) for i in range(plain)]
        got = {r.path: r.own for r in scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
        assert got == {p: None if p[0] == "q" else "MIT" if "MIT" in held else "Apache-2.0" for p, _ in rows}


@pytest.mark.parametrize("n", [100, 30000])
def test_licence_line_with_a_common_word_more(spark, n):
    lines = {"a/x.c": "some Licensed under the Apache License, Version 2.0."}
    rows = spark.createDataFrame(list(lines.items()), "path string, text string").unionByName(spark.range(n).select(F.concat(F.lit("b/"), "id").alias("path"), F.lit("some file of code").alias("text")))
    got = {r.path: (r.own, r.cosine) for r in scanned(rows).where("own is not null").collect()}
    w = 1 + np.log((n + 2) / 2)
    assert got == {"a/x.c": ("Apache-2.0", pytest.approx((8 * w * w / (8 * w * w + 1)) ** 0.5, abs=1e-8))}


def test_empty_tables(spark, none):
    assert near_duplicates(none).count() == repeated_bytes(none).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(none, bench).count() == 0 and extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert derivatives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stages_keep_columns_and_clean_documents(spark, docs, rows, none, tmp_path):
    sf = "/root/testdata/sf0.001"
    own = docs.drop("id", "bucket", "kind")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, own, none):
            out = stage(spark, d, sf)
            assert out.columns == d.columns, name
            out.count()
    left = {r.doc_id: r.text for r in corpus_pipeline.suffix_array(spark, docs, sf).collect()}
    want = brute.repeats(rows)
    assert all(left[i] == want[i][4].decode("utf-8", "ignore") for i in want if i not in (15, 16))
    comp, _ = brute.near([i for i, _ in rows], [t for _, t in rows], 80)
    kept = [r.doc_id for r in corpus_pipeline.minhash(spark, docs.unionByName(docs.where("doc_id = 4")), sf).collect()]
    assert sorted(str(k) for k in kept) == sorted([*(str(i) for i in comp if comp[i] == i), "None"])


def test_pipeline_runs_and_decisions_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = Scratch(spark, "t").cut(stage(spark, after, sf))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in after.collect()} and 0 < after.count() < docs.count()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for r in after.collect():
        n, hit, _ = brute.hits(r.text, items)
        assert not (hit and 20 * hit >= n)


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    d = dict(zip(*pq.read_table(f"{sf}/documents.parquet").select(["doc_id", "text"]).to_pydict().values(), strict=True))
    for r in entries.op7_repeats(spark, sf).collect():
        assert r.n_bytes == len(d[r.doc_id].encode())
    for r in entries.op3_decontaminate(spark, sf).collect():
        assert r.n_items or r.items_sha256 == hashlib.sha256(b"").hexdigest()
    for r in entries.op10_language_model(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_freed_memory_of_the_driver_goes_back(spark):
    from pathlib import Path

    from vigilspark.llm.shared import Scratch

    held = lambda: int(next(x for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("VmRSS")).split()[1])
    blocks = [bytes(1000) for _ in range(200_000)]
    last = bytes(1000)
    del blocks
    before = held()
    Scratch(spark, "settled").cut(spark.range(3))
    assert last and held() < before - 100_000

"""Main text of pages against a plain version, pages made with their text known, and the part that clusters play."""

import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from vigilspark.llm import entries, html_text
from vigilspark.llm.html_text import extracted, main_text


def article_text(page):
    """The blocks of the one article element, by patterns alone."""
    body = re.search(r"(?s)<article>(.*?)</article>", page).group(1)
    blocks = re.split(r"</?(?:p|h1|h2|h3|h4|ul|ol|li|div|section|blockquote|pre|table|tr|td|th|figure|hr)\b[^>]*>", body)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_query_gives_the_articles_of_all_pages(spark):
    t = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pydict()
    got = {r.page_id: r for r in entries.op5_html(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(t["page_id"])
    for i, u, h in zip(t["page_id"], t["url"], t["html"], strict=True):
        assert (got[i].url, got[i].text, got[i].n_chars) == (u, article_text(h), len(article_text(h)))


def test_names_of_an_articles_parts_drop_nothing():
    long = "Words of the article that go on for a while, " * 6
    page = f'<nav>menu</nav><article><h2 id="related-work">Related work</h2><p class="search-terms">{long}</p><h2 class="comments" id="comments-on-method">On method</h2><div id="social-effects"><p>{long}</p></div><p id="notice">Note</p><div class="comments"><p>said {long}</p></div><div id="comments">said too</div><p class="ad">buy</p></article>'
    assert main_text(page) == "\n\n".join(["Related work", long.strip(), "On method", long.strip(), "Note"])


def unmarked(seed):
    """A page without article or main element whose parts have meaningless names, and its article."""
    r = np.random.default_rng(seed)
    words = lambda n: " ".join(f"w{k}" for k in r.integers(0, 500, n))
    links = lambda n: "".join(f'<li><a href="/{k}"><span>{words(2)}</span></a></li>' for k in range(n))
    blocks = [f"Title {seed}", *(words(int(n)) for n in r.integers(25, 80, 6)), "Short end."]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    page = f'<html><body><div class="x1"><ul>{links(12)}</ul></div><div class="x2"><div class="x3">{body}</div><div class="x4"><ul>{links(8)}</ul></div></div><div class="x5">{"".join(f"<a href=q>{words(1)}</a> | " for _ in range(9))}</div></body></html>'
    return page, "\n\n".join(blocks)


@pytest.mark.parametrize("seed", range(8))
def test_clusters_elect_the_article_of_unmarked_pages(seed, monkeypatch):
    page, want = unmarked(seed)
    assert main_text(page) == want
    # without clusters the lists of links would be text
    monkeypatch.setattr(html_text, "content_lines", lambda ratio, part: np.ones(len(ratio), bool))
    assert main_text(page) != want and "w" in main_text(page)


def test_clusters_choose_among_marked_elements(monkeypatch):
    long = "Words of the article that go on for a while, " * 6
    cards = "".join(f'<article><a href="/{i}"><b><i>{i}</i></b></a><a href="/{i}"><u>more</u></a></article>' for i in range(6))
    page = f"<article><h1>Head</h1><p>{long}</p><p>{long}</p></article>{cards}"
    want = f"Head\n\n{long.strip()}\n\n{long.strip()}"
    assert main_text(page) == want
    monkeypatch.setattr(html_text, "content_lines", lambda ratio, part: np.ones(len(ratio), bool))
    assert "more" in main_text(page)


def test_very_long_pages(spark):
    words = " ".join(f"w{i % 977}" for i in range(60_000))
    page = f"<body><nav><a>menu</a></nav><article>{''.join(f'<p>{words}</p>' for _ in range(3))}<div class=sidebar>{words}</div></article><footer>{words}</footer></body>"
    rows = [(1, "u", page), (2, "u", ""), (2, "u", "<" * 100_000), (3, None, "<div>" * 3000 + "deep")]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), carry=["url"]).collect()
    assert got[0].text == "\n\n".join([words] * 3) and got[0].n_chars == len(got[0].text) and got[1].text == "" and got[3].text == "deep"

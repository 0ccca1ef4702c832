"""Main text of HTML pages: streaming parser events, text-to-tag ratio of each line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import carried

#: Elements that end a line of text where they begin or end.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements of which nothing is text of the article.
DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form head iframe input map menu meter nav noscript object optgroup option output picture progress script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that tell menus, notices, adverts, comments and the like.
SIGNS = frozenset("ad ads advert adverts advertisement advertising adslot adsense alert banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disqus disclaimer dropdown footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pagination paywall popup promo promotion recommended recommendations related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: Elements that are dropped only if one of their classes as a whole is such a word, and elements that never are, whatever their names.
MARKED_WHOLE = frozenset("p li span a b i em strong blockquote pre code td tr table figure dl dt dd".split())
NAMED_FREELY = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Ids that tell reader comments and the like within an article, where other ids name its parts.
ARTICLE_IDS = frozenset("ad ads comment comments disqus newsletter replies respond sidebar".split())
#: Elements that mark an article.
ARTICLES = frozenset(("article", "main"))
#: Elements within which lines belong together.
HOLDERS = frozenset("article main section div td body center dd".split())
_WORD = re.compile(r"[a-z]+")


class Lines(HTMLParser):
    """Lines of visible text with the number of tags in each and the holder it lies in; what is dropped as a whole never becomes a line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags = 0
        self.skip: str | None = None
        self.depth = 0
        #: open holders: (element, number); holder 0 is the page; up: the holder around each, kinds: the element of each
        self.open: list[tuple[str, int]] = []
        self.up, self.kinds = [0], ["page"]

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1][1] if self.open else 0))
        elif self.tags and self.lines:
            # tags without text weigh on the line before
            line = self.lines[-1]
            self.lines[-1] = (line[0], line[1] + 1, line[2])
        self.text, self.tags = [], 0

    def is_dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        inside = any(t in ARTICLES for t, _ in self.open)
        if tag in DROPPED or tag == "header" and not inside:
            return True
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                return True
            if not v or tag in NAMED_FREELY or k not in ("class", "id", "role"):
                continue
            v = v.lower()
            if k == "id" and (inside or tag in MARKED_WHOLE):
                named = inside and tag not in MARKED_WHOLE and v in ARTICLE_IDS
            else:
                named = not SIGNS.isdisjoint(v.split() if tag in MARKED_WHOLE else _WORD.findall(v))
            if named:
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            self.depth += tag == self.skip
            return
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if self.is_dropped(tag, attrs):
            if tag not in VOID:
                self.skip, self.depth = tag, 1
            return
        self.tags += 1
        if tag in HOLDERS:
            self.up.append(self.open[-1][1] if self.open else 0)
            self.kinds.append(tag)
            self.open.append((tag, len(self.up) - 1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.depth -= tag == self.skip
            if not self.depth or tag in ("body", "html"):
                self.skip = None
            return
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in HOLDERS and any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def smoothed(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = 3
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratio, r, mode="edge"), kernel, "valid")


def content_lines(ratio: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Lines of the upper of two clusters of ratios, smoothed within each run of equal parts, by a threshold between the means; all, if they hardly differ."""
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    s = np.concatenate([smoothed(x) for x in np.split(ratio, cuts)])
    cut = s.mean()
    for _ in range(50):
        hi, lo = s[s >= cut], s[s < cut]
        new = (hi.mean() + lo.mean()) / 2 if len(hi) and len(lo) else cut
        if abs(new - cut) < 1e-9:
            break
        cut = new
    lo = s[s < cut]
    return s >= (cut if len(lo) and s[s >= cut].mean() > 2 * lo.mean() else -1)


def parsed(html: str, kind: type[Lines] = Lines) -> Lines:
    p = kind()
    try:
        p.feed(html)
        p.close()
    except AssertionError:
        # a declaration that the parser gives up on is text
        p = kind()
        p.feed(html.replace("<![", "&lt;!["))
        p.close()
    p.flush()
    return p


def main_text(html: str | None) -> str:
    """The lines of content regions, joined by blank lines.

    Content lines vote, by length, for the article or main element around them, or else the nearest holder. A region is elected if over half of its
    text is in content lines; of an element that marks an article a fifth is enough. Elected marked regions with a third of all content lines' text or more
    are the article alone, else all elected ones are it. Short lines between and beside long ones belong to their region. Without any elected region
    marked ones, or all, are taken.
    """
    if not html:
        return ""
    p = parsed(html)
    if not p.lines:
        return ""

    def region(h: int) -> int:
        near = h
        while h:
            if p.kinds[h] in ARTICLES:
                return h
            h = p.up[h]
        return near

    of = [region(h) for _, _, h in p.lines]
    ratio = np.array([len(t) / max(1, n) for t, n, _ in p.lines])
    # what is marked is smoothed on its own
    hit = content_lines(ratio, np.array([r if p.kinds[r] in ARTICLES else -1 for r in of]))
    size, content = {}, {}
    for (t, _, _), r, x in zip(p.lines, of, hit, strict=True):
        size[r] = size.get(r, 0) + len(t)
        content[r] = content.get(r, 0) + len(t) * bool(x)
    marked = {r for r in size if p.kinds[r] in ARTICLES}
    own = {r for r in size if content[r] * (5 if r in marked else 2) > size[r]}
    if 3 * sum(content[r] for r in own & marked) >= sum(content.values()) and own & marked:
        own &= marked
    own = own or marked or set(size)
    return "\n\n".join(t for (t, _, _), r in zip(p.lines, of, strict=True) if r in own)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            texts = [main_text(h) for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *part.columns[2:]], names=["id", "text", "n", *batch.schema.names[2:]])


def extracted(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """One row per page: id_col, the columns named in carry, text, n_chars (code points).

    Null and empty pages have an empty text. Broken markup is read as the parser reads it. Repeated rows and rows without an id give a row each.
    """
    ship(pages.sparkSession)
    src, schema, back = carried(pages, id_col, html_col, [c for c in carry or [] if c != html_col])
    out = src.mapInArrow(_extract, "id long, text string, n long" + schema.replace(", __t string", "", 1))
    return out.select(F.col("id").alias(id_col), *back, "text", F.col("n").alias("n_chars"))

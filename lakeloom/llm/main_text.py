"""Main text of HTML pages by tree scoring.

A page becomes a tree of block elements. Each paragraph passes points for its length and commas to its parent,
half of them to the grandparent and a third to the next; an element's points are discounted by its link
density, and points from within elements whose class or id speaks of menus, adverts and the like count for little.
The best element is kept with those of its siblings that score well enough themselves. Such names only tell what to
leave out beside or within the best element, never above it. All passes over elements and blocks are linear.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements, and words of class, id and role attributes that mark what is no article.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas select option textarea button head title datalist audio video map".split())
#: Their text is not markup: without an end tag it goes on to the end of the page, and they cannot be self-closed.
RAW = frozenset("script style textarea title".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address summary".split())
CONTAINER = frozenset("html body article main section div header ul ol dl table thead tbody tfoot tr figure fieldset details center".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related replies respond rss share sharing sidebar skyscraper social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words before a mark with which a class tells of a page's layout, not of its own text.
LAYOUT = frozenset("has with no without show hide is".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())
#: An open element of the second kind ends where one of the first kind begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
SELF_CLOSED = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=\"'/]+)/\Z")
WORD = re.compile(r"[a-z]+")
#: What points from within a marked element count: marked by a whole class name or id, or by a word of a longer one.
WHOLE, PART = 0.1, 0.3


class Page:
    """Elements (parent, name, left out whatever its score, weight of its mark) and blocks of text (element, text, characters within links)."""

    def __init__(self, source: str):
        self.parent, self.name, self.gone, self.weight, self.article = [-1], ["html"], [False], [1.0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # of each name, where it is on the stack of open elements
        self.parts: list[str] = []
        self.links, self.in_link = 0, False
        self.read(source)

    def cut(self, at: int) -> None:
        for e in self.open[at:]:
            self.places[self.name[e]].pop()
        del self.open[at:]

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text and not self.gone[self.open[-1]]:
                self.blocks.append((self.open[-1], text, min(self.links, len(text))))
        self.parts, self.links = [], 0

    def text(self, s: str) -> None:
        if s:
            self.parts.append(s)
            if self.in_link:
                self.links += len(s.strip())

    def read(self, source: str) -> None:
        at, unclosed = 0, set()  # names without an end tag from here on
        while True:
            m = TOKEN.search(source, at)
            if not m:
                self.text(source[at:])
                break
            self.text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self.end(name)
                continue
            if name in HIDDEN:
                if name in unclosed or (name not in RAW and SELF_CLOSED.search(m[3] or m[6] or "")):
                    continue
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                if close:
                    at = close.end()
                elif name in RAW:
                    at = len(source)
                else:
                    unclosed.add(name)
                continue
            self.begin(name, m[3] or m[6] or "")
        self.flush()

    def begin(self, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = True
        elif name in ("br", "hr"):
            self.parts.append(" ")
            if name == "hr":
                self.flush()
        elif name in VOID:
            pass
        elif name in PARAGRAPH or name in CONTAINER or name in BOILERPLATE:
            self.flush()
            if name in CLOSES:
                last = lambda names: max((p[-1] for n in names if (p := self.places.get(n))), default=0)
                if (at := last(CLOSES[name])) > last(STOPS[name]):
                    self.cut(at)
            if self.name[self.open[-1]] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                self.cut(len(self.open) - 1)
            if name == "html" and len(self.open) > 1:
                return
            above = self.open[-1]
            gone, weight = self.judged(name, attributes, self.article[above])
            self.parent.append(above)
            self.name.append(name)
            self.gone.append(self.gone[above] or gone)
            self.weight.append(weight)
            self.article.append(self.article[above] or name in ("article", "main"))
            self.places.setdefault(name, []).append(len(self.open))
            self.open.append(len(self.parent) - 1)

    def judged(self, name: str, attributes: str, in_article: bool) -> tuple[bool, float]:
        """Whether an element is left out whatever its score, and the weight that its class and id give it."""
        if name in ("html", "body", "article", "main"):
            return False, 1.0
        if name in BOILERPLATE or (name == "header" and not in_article):
            return True, 1.0
        weight = 1.0
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return True, 1.0
            if key == "role" and value in ROLES:
                return True, 1.0
            if key in ("class", "id"):
                for token in value.split():
                    words = WORD.findall(token)
                    if token in MARKS:
                        weight = min(weight, WHOLE)
                    elif name in CONTAINER and not LAYOUT.intersection(words) and not MARKS.isdisjoint(words):
                        weight = min(weight, PART)
        return False, weight

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        elif name in PARAGRAPH or name in CONTAINER or name in BOILERPLATE:
            self.flush()
            if self.places.get(name):
                self.cut(self.places[name][-1])

    def main(self) -> list[str]:
        n = len(self.parent)
        weight, points, size, linked = list(self.weight), [0.0] * n, [0] * n, [0] * n
        for e in range(1, n):
            weight[e] *= weight[self.parent[e]]
        for e, text, links in self.blocks:
            up = e if self.name[e] not in PARAGRAPH else self.parent[e]
            value = (1 + text.count(",") + min(len(text) / 100, 3)) * weight[e]
            for share in (1, 2, 3):
                if up >= 0:
                    points[up] += value / share
                    up = self.parent[up]
            size[e] += len(text)
            linked[e] += links
        if not self.blocks:
            return []
        for e in range(n - 1, 0, -1):  # parents come before their children
            size[self.parent[e]] += size[e]
            linked[self.parent[e]] += linked[e]
        plain = [1 - linked[e] / max(1, size[e]) for e in range(n)]
        score = [points[e] * plain[e] for e in range(n)]
        best = max((e for e in range(n) if points[e]), key=lambda e: (score[e], -e))
        up, above = best, set()
        while up > 0:
            if self.name[up] in ("article", "main"):
                best = up
            above.add(up)
            up = self.parent[up]
        kept, left = [False] * n, [False] * n
        for e in range(n):
            near = e > 0 and best > 0 and self.parent[e] == self.parent[best] and size[e] > 0
            kept[e] = e == best or (near and (score[e] >= 0.2 * score[best] > 0 or (self.name[e] == "p" and size[e] > 80 and plain[e] > 0.75)))
            if e:
                kept[e] = kept[e] or kept[self.parent[e]]
                left[e] = left[self.parent[e]] or (self.weight[e] < 1 and e not in above)
        return [text for e, text, _ in self.blocks if kept[e] and not left[e]]


def main_text(source: str | None) -> str:
    return "\n".join(Page(source or "").main())


def extract_main_text(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url, text and n_chars.

    Null or empty html gives an empty text, as does a page without text outside menus and the like. Equal rows
    get equal texts; broken markup is read as far as it goes, and pages of any length and depth in linear time. Other
    columns, whatever their names, take no part; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(s) for s in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

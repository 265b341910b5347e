"""Main text of web pages by tag-path ratios.

A page is read into blocks (paragraphs, headings, list items, cells ...), each with its tag path: the block-level
elements from the root to it, with their classes. All blocks of one path are judged together, since a template repeats
its paths: text length per block, less its links, and punctuation per block. The ratios of a path are smoothed with those of its
neighbours in the same container, the two are fused by their geometric mean, and paths under a share of the best are dropped. Inside <article> or <main> a ratio counts twice.
Elements that are never an article's text (menus, headers, footers, asides, forms, scripts, elements that name
themselves advert, comment, notice and so on) are left out before. A form, or an element left out by its name or role, that holds
most of a page's text is judged by its paths like the rest, unless it is a section of comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotab.llm.common import slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template head title button select option textarea iframe svg canvas object applet video audio map datalist math".split())
NEVER = UNREAD | frozenset("nav header footer aside form dialog menu".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre address figure figcaption center details summary hgroup fieldset legend search".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
#: A start tag of the key ends an open element of the value, up to the nearest of its containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Elements that are the page or its article, whatever they are called.
WHOLE = frozenset("html body main article".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Words of a class or id that mark an element as something other than the article, and words that say nothing beside them.
#: A name is such a mark if all its words are of these: 'footer-widgets' is one, 'no-sidebar' and 'tag-news' are not.
ASIDE = COMMENTS | frozenset(
    "nav navbar navigation menu topbar sidebar aside rail footer foot header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert banner popup modal overlay "
    "newsletter subscribe subscription signup paywall ad ads adv advert advertisement advertising adsbygoogle sponsor sponsored promo promotion social share sharing related recommended recommendations "
    "pagination pager toolbar widget widgets login search copyright legal disclaimer skiplink hidden tag tags".split()
)
BESIDE = frozenset("site main primary secondary mobile desktop global area bar bars block box boxes button buttons container form icon icons inner item items left link links list right section top bottom wrap wrapper posts stories articles".split())
PHRASES = frozenset({"side-bar", "skip-link", "visually-hidden", "sr-only", "byline-ads"})
_WORDS = re.compile(r"[-_\d]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
_SPACE = re.compile(r"\s+")
#: Of the best path's fused ratio, what a path must reach; and the share of link text from which a path is a menu.
THRESHOLD, LINKS = 0.08, 0.75
#: How many times the ratio of a path inside <article> or <main> counts. Not tuned: no table here has labelled pages.
PRIOR = 2


@dataclass
class Block:
    path: int
    text: str
    links: int


#: Why text is not read: it is no text of the page at all, or that of an element which is never an article.
NO_TEXT, NO_ARTICLE = -1, -2


class Reader(HTMLParser):
    """Blocks of a page in order. Paths are numbered in a trie, so a deep page costs no more than its tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # name, path, inside something left out: NO_TEXT, NO_ARTICLE, 0 or its number in `named`
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.trie: dict[tuple[int, str], int] = {}
        self.found: list[tuple[int, list[tuple[int, str, int]]]] = []  # path of a block, its parts: left out in, text, length of links
        self.buffer: list[tuple[int, str, int]] = []
        self.named: list[list[int]] = [[0, 0, 0]]  # elements left out by name: the one around it, whether of comments, length of text in it
        self.length = 0
        self.open_counts: dict[str, int] = {}

    def _here(self) -> tuple[int, int]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, 0)

    def flush(self) -> None:
        if self.buffer:
            self.found.append((self._here()[0], self.buffer))
            self.buffer = []

    def blocks(self) -> list[Block]:
        """The blocks, without what is left out."""
        for around, _, n in reversed(self.named[1:]):  # an element is numbered after those around it
            self.named[around][2] += n
        out = [False]
        for around, comments, n in self.named[1:]:
            out.append(out[around] or comments or 2 * n <= self.length)
        done = []
        for path, parts in self.found:
            text = _SPACE.sub(" ", "".join(t for e, t, _ in parts if not out[e])).strip()
            if text:
                done.append(Block(path, text, sum(n for e, _, n in parts if not out[e])))
        return done

    def _pop(self) -> None:
        name = self.stack.pop()[0]
        self.open_counts[name] -= 1

    def _close(self, names: set[str] | frozenset[str], stop: set[str] = frozenset()) -> None:
        """End the nearest open element of these names, unless a container stands before it."""
        if not any(self.open_counts.get(n) for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in stop:
                return
            if name in names:
                if any(n[0] in BLOCK or n[0] in NEVER for n in self.stack[i:]):
                    self.flush()
                while len(self.stack) > i:
                    self._pop()
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                if tag == "hr":
                    self._close({"p"})
                    self.flush()
                elif tag == "br" and self._here()[1] >= 0:
                    self.buffer.append((self._here()[1], " ", 0))
            return
        if tag in CLOSES_P or tag in NEVER:
            self._close({"p"}, {"td", "th", "table", "button", "caption", "html"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        path, out = self._here()
        if tag in BLOCK or tag in NEVER:
            self.flush()
            label = tag + "".join(f".{c}" for k, v in attrs if k == "class" and v for c in v.split()[:3])
            key = (path, label)
            if key not in self.trie:
                self.trie[key] = len(self.paths)
                self.paths.append((path, tag))
            path = self.trie[key]
        if out != NO_TEXT and (attrs or tag in NEVER):
            out = self._left_out(tag, attrs, out)
        self.stack.append((tag, path, out))
        self.open_counts[tag] = self.open_counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use", "circle", "rect", "g", "line", "polygon"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            return
        self._close({tag}, {"table"} if tag not in ("table", "div", "section", "article", "main", "body") and tag in BLOCK else frozenset())

    def handle_data(self, data: str) -> None:
        out = self._here()[1]
        if out == NO_TEXT:
            return
        n = len(data.strip())
        self.length += n
        if out == NO_ARTICLE:
            return
        self.named[out][2] += n
        self.buffer.append((out, data, n if self.open_counts.get("a") else 0))

    def _left_out(self, tag: str, attrs: list[tuple[str, str | None]], out: int) -> int:
        """What an element's text is left out by: itself, or what its surroundings are left out by."""
        named = comments = False
        for k, v in attrs:
            if tag not in ("html", "body") and (k == "hidden" or v and (k == "aria-hidden" and v.lower() == "true" or k == "style" and _HIDDEN.search(v))):
                return NO_TEXT
            if v and tag not in WHOLE:
                if k in ("class", "id"):
                    for name in v.lower().split():
                        if (kind := _named(name)) is not None:
                            named, comments = True, comments or kind
                elif k == "role" and v.lower() in ROLES:
                    named = True
        if tag in UNREAD:
            return NO_TEXT
        if out == NO_ARTICLE or tag in NEVER and tag != "form":
            return NO_ARTICLE
        if named or tag == "form":
            self.named.append([out, comments, 0])
            return len(self.named) - 1
        return out


@lru_cache(4096)
def _named(name: str) -> bool | None:
    """Whether a class or id names something other than an article: None, or whether it is comments."""
    name = name.rpartition("__")[2]  # block__element: the element
    words = [w for w in _WORDS.split(name) if w]
    if name in PHRASES or any(w in ASIDE for w in words) and all(w in ASIDE or w in BESIDE for w in words):
        return any(w in COMMENTS for w in words)
    return None


def content(blocks: list[Block], paths: list[tuple[int, str]]) -> list[Block]:
    """The blocks whose path has the ratios of an article's text."""
    if not blocks:
        return []
    stats: dict[int, list[float]] = {}  # in page order: length without links, punctuation, blocks, link share
    for b in blocks:
        s = stats.setdefault(b.path, [0.0, 0.0, 0.0, 0.0, 0.0])
        s[0] += max(0, len(b.text) - b.links)
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += 1
        s[3] += b.links
        s[4] += len(b.text)
    text = {p: s[0] / s[2] for p, s in stats.items()}
    marks = {p: (s[1] + 0.5) / s[2] for p, s in stats.items()}
    by_container: dict[int, list[int]] = {}
    for p in stats:
        by_container.setdefault(paths[p][0], []).append(p)
    fused = {}
    for siblings in by_container.values():
        for i, p in enumerate(siblings):
            near = siblings[max(0, i - 1) : i + 2]
            smooth = lambda ratio: 0.5 * ratio[p] + 0.5 * max(ratio[x] for x in near)  # noqa: B023, E731
            fused[p] = (smooth(text) * smooth(marks)) ** 0.5
    least = THRESHOLD * max(fused.values())
    in_article: dict[int, bool] = {-1: False}

    def inside(p: int) -> bool:
        chain = []
        while p not in in_article:
            chain.append(p)
            if paths[p][1] in ("article", "main"):
                in_article[p] = True
                break
            p = paths[p][0]
        for c in chain:
            in_article[c] = in_article[p]
        return in_article[p]

    # A mark is a prior alone: it raises a path's ratio, and every path is held against the same threshold. Links make up
    # a menu, but not a heading or paragraph of a marked article.
    out = set()
    for p, s in stats.items():
        marked = inside(p)
        if fused[p] * (PRIOR if marked else 1) >= least and (s[3] < LINKS * s[4] or marked and paths[p][1] not in ("li", "ul", "ol", "div")):
            out.add(p)
    return [b for b in blocks if b.path in out]


def main_text(html: str) -> str:
    """The article's blocks, one per line."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return "\n".join(b.text for b in content(reader.blocks(), reader.paths))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. NULL is an empty page, whose text is empty; a page without an
    article has an empty text. Rows are independent; other columns are ignored."""
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [main_text(h) for h in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

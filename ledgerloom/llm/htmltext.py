"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between the edges of block elements), each with its path: the block elements from the root
on, with their classes. Text length, punctuation and link text are summed per path. Text and punctuation per block of the
path are smoothed along the page (the geometric mean with the path's own, so that a short box beside an article gains
little), fused with the share of text that isn't link text and with a prior of the path, averaged
per path, and held against a share of the page's mean: paths above it hold the main text. The content node is the deepest
element with most of the chosen text, or the article around it; paths inside of it need a smaller share.

The prior is one factor among these: low for elements whose name or class says that they hold adverts, comments, forms,
notices and the like, which can be long prose as well, milder for menus by class and for text outside of the article, and 1
for all else. Link lists, site names, short boxes and whatever else has no telling name go by their ratios alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._util import map_arrow

#: Weights of the smoothing for a block and its neighbours at 1 and 2 blocks.
SMOOTH = (0.1, 0.2, 0.4, 0.2, 0.1)
#: Paths are chosen from this share of the page's mean score on, the mean weighted by text length; inside the content node.
SHARE, INNER = 0.1, 0.001
#: Score that a chosen path has at least: pages without main text have none.
LEAST = 0.5
#: Prior of marked elements, of menus by class, and of text outside of article and main elements on pages that have one.
MARKED, MENU, OUTSIDE = 1e-7, 0.01, 0.2
#: Paths of which more is link text aren't taken for being in the content node.
LINKS = 0.6
#: Share of the chosen text that the content node holds.
MOST = 0.7

#: Fixed values of HTML: elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt frameset head html legend li option optgroup tbody td tfoot th thead tr".split())
#: A start tag ends an open element of these, unless one of the last named stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Elements without text to read.
SKIP = frozenset("head script style noscript template button select textarea option iframe svg math canvas object audio video map".split())
#: Elements that are marked by their name.
ASIDE = frozenset("aside form dialog search footer".split())
#: Words of a class, an id or a role that mark elements without main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner "
    "topbar masthead footer sidebar aside cookie cookies consent notice notices gdpr "
    "popup modal overlay comment comments disqus reply replies respond discussion related recommended recommendations "
    "share sharing social subscribe subscription newsletter signup login search "
    "widget skip alert contentinfo complementary copyright".split()
)
#: Words that mark menus.
MENUS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar".split())
#: Beginnings of such words that are written together with others.
MARK_STARTS = ("cookie", "advert", "sidebar", "newsletter", "popup", "footer", "sponsor", "comments", "commentlist")
#: Marks that hold even for an article or main element.
STRICT = frozenset("ad ads advert advertisement sponsored promo comment comments reply related cookie".split())
#: Words of a class or an id that mark an article.
ARTICLE = frozenset("article post entry story content".split())
PUNCTUATION = re.compile(r"[.,;:!?¡¿、。，！？،؟।]")

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++|<)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that are parts of a content node.
LEAVES = frozenset("p li ul ol h1 h2 h3 b strong em i span blockquote pre".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class, id and role; the class as it stands in paths; whether the element is hidden."""
    words, kind, hidden = set(), "", False
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            words.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
            if name == "class":
                kind = _NUMBER.sub("0", value)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            hidden = True
    return words, kind, hidden


def _prior(tag: str, words: set[str], inside: bool) -> float:
    """How likely an element is to hold main text, by its name and the words of its class; inside: of an article or main element."""
    if tag in ("html", "body"):
        return 1.0
    if tag in ("article", "main"):
        return MARKED if words & STRICT else 1.0
    if tag in ASIDE or (not inside and (tag == "header" or ("header" in words and tag not in ("h1", "h2")))):
        return MARKED
    if not words:
        return 1.0
    if words & MARKS or any(w.startswith(MARK_STARTS) for w in words):
        return MARKED
    return MENU if words & MENUS else 1.0


class _Open:
    """An open element."""

    __slots__ = ("tag", "path", "number", "skipped", "prior", "within", "link")

    def __init__(self, tag="", path=0, number=0, skipped=False, prior=1.0, within=False, link=False):
        self.tag, self.path, self.number, self.skipped, self.prior, self.within, self.link = tag, path, number, skipped, prior, within, link


class Page:
    """Blocks of a page: text, link characters, path, prior, and the elements they are in."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.links: list[int] = []
        self.paths: list[int] = []
        self.nodes: list[int] = []
        self.priors: list[float] = []
        self.within: list[bool] = []
        #: parent of each element; 0 is the page
        self.parent, self.names = [0], [""]
        self._known: dict[tuple[int, str, str], int] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        stack = [_Open()]
        where: dict[str, list[int]] = {}  # places of the open elements of each name
        piece: list[str] = []
        linked = 0
        pos, size = 0, len(source)

        def flush():
            nonlocal linked
            if piece:
                text = " ".join("".join(piece).split())
                if text:
                    top = stack[-1]
                    self.texts.append(text)
                    self.links.append(min(linked, len(text)))
                    self.paths.append(top.path)
                    self.nodes.append(top.number)
                    self.priors.append(top.prior)
                    self.within.append(top.within)
                piece.clear()
            linked = 0

        def pop(place: int) -> None:
            while len(stack) > place:
                got = stack[-1].tag
                if got in BLOCK:
                    flush()
                stack.pop()
                where[got].pop()

        while pos < size:
            m = _TOKEN.match(source, pos)
            pos = m.end()
            text = m[7]
            if text is not None:
                if not stack[-1].skipped:
                    text = html.unescape(text)
                    piece.append(text)
                    if stack[-1].link:
                        linked += len(text.strip())
                continue
            name = m[2] or m[5]
            if name is None:
                continue
            tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if where.get(tag):
                    pop(where[tag][-1])
                elif tag in BLOCK:
                    flush()
                continue
            if tag in CLOSES_P and where.get("p"):
                pop(where["p"][-1])
            if tag in ENDS:
                ends, stops = ENDS[tag]
                stop = max((where[x][-1] for x in stops if where.get(x)), default=0)
                found = [where[x][i] for x in ends if where.get(x) and (i := bisect_right(where[x], stop)) < len(where[x])]
                if found:
                    pop(min(found))
            if tag in BLOCK:
                flush()
            if tag in VOID:
                piece.append(" ")
                continue
            top = stack[-1]
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                pos = end.end() if end else size
                continue
            number = len(self.parent)
            self.parent.append(top.number)
            self.names.append(tag)
            words, kind, hidden = _named(attributes) if attributes and not attributes.isspace() else (set(), "", False)
            skipped = top.skipped or tag in SKIP or (hidden and tag not in ("html", "body"))
            own = _prior(tag, words, top.within)
            if (skipped and not top.skipped) or own < 1:
                flush()
            prior = own if tag in ("article", "main") and top.prior > MARKED else min(top.prior, own)
            within = top.within or tag in ("article", "main") or (tag in ("div", "section", "td") and not ARTICLE.isdisjoint(words))
            path = self._known.setdefault((top.path, tag, kind), len(self._known) + 1) if tag in BLOCK else top.path
            where.setdefault(tag, []).append(len(stack))
            stack.append(_Open(tag, path, number, skipped, prior, within, top.link or tag == "a"))
        flush()

    def sums(self) -> tuple[np.ndarray, ...]:
        """Number of the path of each block, and per path its blocks, characters, punctuation marks and characters in links."""
        path = np.unique(np.array(self.paths), return_inverse=True)[1]
        length = np.array([len(t) for t in self.texts], float)
        marks = np.array([len(PUNCTUATION.findall(t)) for t in self.texts], float)
        return path, np.bincount(path), np.bincount(path, length), np.bincount(path, marks), np.bincount(path, np.array(self.links, float))

    def ratios(self) -> np.ndarray:
        """Of each block, its path's ratios of text and of text with punctuation, each the geometric mean of its own and of
        the one smoothed along the page, fused, times the share of what isn't link text."""
        path, blocks, length, marks, links = self.sums()
        text, dots = (length / blocks)[path], (marks / blocks)[path]
        smooth = lambda x: np.convolve(np.pad(x, 2, "edge"), SMOOTH, "valid")
        return np.sqrt(text * smooth(text) * (1 + dots) * (1 + smooth(dots))) * (1 - links / length)[path]

    def scores(self) -> np.ndarray:
        """The score of each block's path: the mean of its blocks' ratios times their priors."""
        path = np.unique(np.array(self.paths), return_inverse=True)[1]
        within = np.array(self.within)
        prior = np.array(self.priors) * np.where(within | ~within.any(), 1, OUTSIDE)
        return (np.bincount(path, self.ratios() * prior) / np.bincount(path))[path]

    def content_node(self, chosen: np.ndarray) -> int:
        """The deepest element with MOST of the chosen text."""
        total = np.zeros(len(self.parent))
        for i in np.flatnonzero(chosen):
            total[self.nodes[i]] += len(self.texts[i])
        for i in range(len(total) - 1, 0, -1):  # parents have lower numbers
            total[self.parent[i]] += total[i]
        enough = np.flatnonzero(total >= MOST * total[0])
        return int(enough[-1])

    def main_text(self) -> str:
        if not self.texts:
            return ""
        score = self.scores()
        length = np.array([len(t) for t in self.texts], float)
        mean = np.average(score, weights=length)
        chosen = score >= max(SHARE * mean, LEAST)
        if not chosen.any():
            return ""
        node = self.content_node(chosen)
        while self.names[node] in LEAVES and self.parent[node]:
            node = self.parent[node]
        up = node
        while up and self.names[up] not in ("article", "main"):
            up = self.parent[up]
        node = up or node
        if self.names[node] not in ("", "html", "body"):
            inside = np.zeros(len(self.parent), bool)
            inside[node] = True
            for i in range(node + 1, len(inside)):
                inside[i] = inside[self.parent[i]]
            own = inside[np.array(self.nodes)]
            chosen = chosen | (own & (score >= INNER * mean) & (np.array(self.links) <= LINKS * length))
        return "\n\n".join(t for t, c in zip(self.texts, chosen.tolist(), strict=True) if c)


def main_text(source: str | None) -> str:
    """The main text of one page, empty for null."""
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html); other columns are ignored.

    Character references are decoded, white space in a block is one space, blocks are joined by two line ends. A null
    or empty html, and a page without text outside of what is left out, give an empty text. Rows that repeat give equal
    rows; null ids and urls stay null.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(map_arrow, run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

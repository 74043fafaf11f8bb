"""Main-text extraction from HTML by flat text blocks and a decision tree.

A page is cut into flat text blocks at every tag that is not inline.  A block is
described by its word count and link density, those of the blocks before and after
it, and by the names (elements, classes, ids, roles) of what encloses it.  How far a
name speaks for or against article text is counted in a small labelled table
(``training_pages``); a name that the table does not have says nothing, and a compound
no more than its head ("cookie-banner" is a banner, "social-issues" are issues).  A decision
tree grown on the same table decides.

One pass reads a page from left to right and never looks at a character twice but
for the first tag whose quotes do not close; what encloses a block is summed up when
an element opens, so deep and broken pages take no longer than others of their size.

Defined results: null and empty pages give an empty text; repeated rows each give
theirs.  Markup that never closes, stray ``<`` signs and tags inside scripts are
tolerated.  Columns called ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import dataclasses
import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import groups

#: Elements whose content is never text of the page.
_RAW = {k: re.compile(rf"</{k}(?=[\s/>])[^>]*+>", re.I) for k in "script style template iframe title textarea select head".split()}
#: Of these, the ones that swallow the rest of the page if they do not close, as in a browser.
_SWALLOW = frozenset("script style title textarea template iframe".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em embed font i img input ins kbd label mark math object output picture q rp rt ruby s samp small source span strike strong sub sup svg time track tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that mark the article of a page, and those that a stray end tag does not close.
_ARTICLE, _WALLS = frozenset(("article", "main")), frozenset(("article", "main", "body"))
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag: a quote opens a value after an equals sign only.
_TAG_END = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
_ATTR = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: What each feature of a block means, in order.
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "article", "article_page", "against_within", "against_around", "in_favour", "heading", "paragraph", "list",
)


@dataclasses.dataclass(frozen=True, slots=True)
class Place:
    """What encloses a block: the names within the innermost article (or all, if there is none), those around it, and the block's own kind."""

    article: bool = False
    within: frozenset[str] = frozenset()
    around: frozenset[str] = frozenset()
    kind: str = ""


_KINDS = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), **dict.fromkeys(("p", "blockquote", "pre"), "paragraph"), **dict.fromkeys(("li", "ul", "ol", "dl", "dd", "dt"), "list")}
#: Names are kept of elements that say what a part of a page is for; of the others only classes and the like.
_TELLING = frozenset("nav menu footer header aside form fieldset dialog address".split())


def names(tag: str, attrs: str) -> frozenset[str]:
    """Names that an element gives to what it encloses: words of a class or an id, joined by - where one has several."""
    found = {f"<{tag}>"} if tag in _TELLING else set()
    if attrs:
        if _HIDDEN.search(attrs):
            found.add("hidden")
        for m in _ATTR.finditer(attrs):
            said = m[2] or m[3] or m[4] or ""
            for word in said.split():
                found.add("-".join(x.lower().removesuffix("s") if len(x) > 3 else x.lower() for x in _PART.findall(word)))
    return frozenset(found)


@dataclasses.dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    place: Place


def _inside(outer: Place, tag: str, attrs: str) -> Place:
    own = names(tag, attrs)
    kind = _KINDS.get(tag, outer.kind if tag not in ("div", "section", "table", "body") else "")
    if tag in _ARTICLE:
        # an element around the article stays around it; what the article is called itself is another matter than a part of it
        return Place(True, frozenset(x if x[0] == "<" or x == "hidden" else f"={x}" for x in own), outer.around | outer.within, kind)
    if own <= outer.within:
        return outer if kind == outer.kind else dataclasses.replace(outer, kind=kind)
    return Place(outer.article, outer.within | own, outer.around, kind)


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []
    #: Open elements by name since the last wall, for each wall: an end tag of none of them is passed over at once.
    open_: list[Counter[str]] = [Counter()]
    top = Place()
    parts: list[str] = []
    links: list[str] = []
    in_link = False
    quoted = True
    unclosed: set[str] = set()

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, text.count(" ") + 1, len(html.unescape("".join(links)).split()), top))
            parts.clear()
            links.clear()

    def say(piece: str) -> None:
        parts.append(piece)
        if in_link:
            links.append(piece + " ")

    def pop() -> str:
        nonlocal top
        name, top = stack.pop()
        if name in _WALLS:
            open_.pop()
        else:
            open_[-1][name] -= 1
        return name

    at, n = 0, len(page)
    while at < n:
        to = page.find("<", at)
        if to < 0:
            say(page[at:])
            break
        if to > at:
            say(page[at:to])
        if page.startswith("<!--", to):
            end = page.find("-->", to + 4)
            at = end + 3 if end >= 0 else n
            continue
        follows = page[to + 1 : to + 2]
        if follows in ("!", "?") or (follows == "/" and not page[to + 2 : to + 3].isalpha()):
            end = page.find(">", to)
            at = end + 1 if end >= 0 else n
            continue
        closing = follows == "/"
        m = _NAME.match(page, to + 1 + closing)
        if not m:
            say("<")
            at = to + 1
            continue
        first = page.find(">", m.end())
        if first < 0:
            say(page[to:])  # no tag ends from here on
            break
        end = first + 1
        if quoted and any(q in m.string[m.end() : first] for q in "\"'"):
            whole = _TAG_END.match(page, m.end())
            quoted = whole is not None  # else tags end at their first > from here on
            end = whole.end() if whole else end
        at = end
        name, attrs = m[0].lower(), page[m.end() : end - 1]
        if name in _RAW and not closing:
            if name != "select":
                flush()
            shut = None if name in unclosed else _RAW[name].search(page, at)
            if shut:
                at = shut.end()
            elif name in _SWALLOW:
                at = n
            else:
                unclosed.add(name)
            continue
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            continue
        flush()
        if name in _VOID:
            continue
        if closing:
            if name in _WALLS or name == "html":
                if any(x[0] == name for x in stack) if name != "html" else stack:
                    while stack and pop() != name:
                        pass
            elif open_[-1][name] > 0:  # a stray end tag does not close the article or a part of the page around it
                while pop() != name:
                    pass
            continue
        if stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            pop()
        if not attrs.rstrip().endswith("/") or name in ("p", "div"):
            stack.append((name, top))
            top = _inside(top, name, attrs)
            if name in _WALLS:
                open_.append(Counter())
            else:
                open_[-1][name] += 1
    flush()
    return out


#: Last words of names that say no more than that something is there, and words that make a phrase of a name, in which the last word is not the head.
_FRAME = frozenset("area bar block box col column container group holder inner item link list outer panel row slot unit wrap wrapper".split())
_JOINING = frozenset("a about and at by for from in of on or the to with".split())


@dataclasses.dataclass
class Speech:
    """Log odds of article text under a name, as counted in labelled blocks; ``^`` marks a name that stands around an article, ``=`` an article's own."""

    odds: dict[str, float]

    @classmethod
    def counted(cls, places: list[Place], article: list[bool]) -> "Speech":
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for place, y in zip(places, article, strict=True):
            for name in (*place.within, *(f"^{k}" for k in place.around)):
                seen[name][y] += 1
        return cls({k: math.log((a + 0.5) / (b + 0.5)) for k, (b, a) in seen.items()})

    def of(self, name: str) -> float:
        """A compound that the table does not have says what its head says, the last word that is no mere frame; other words, and an article's own, say nothing."""
        if name in self.odds or "-" not in name:
            return self.odds.get(name, 0.0)
        mark = "^" if name[0] == "^" else ""
        parts = name[len(mark) :].split("-")
        if name[len(mark)] == "=" or _JOINING & set(parts):
            return 0.0
        while len(parts) > 1 and parts[-1] in _FRAME:
            parts.pop()
        return self.odds.get(mark + "-".join(parts), self.odds.get(mark + parts[-1], 0.0))

    def extremes(self, names: Iterable[str]) -> tuple[float, float]:
        """How far the names speak against article text at most, and for it."""
        odds = [self.of(k) for k in names]
        return max(0.0, -min(odds, default=0.0)), max(0.0, max(odds, default=0.0))


def features(found: list[Block], speech: Speech) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    x = np.zeros((len(found), len(FEATURES)), np.float32)
    known: dict[Place, tuple] = {}
    for i, b in enumerate(found):
        p = b.place
        if p not in known:
            against, favour = speech.extremes(p.within)
            known[p] = (p.article, 0, against, speech.extremes(f"^{k}" for k in p.around)[0], favour, p.kind == "heading", p.kind == "paragraph", p.kind == "list")
        x[i, 0], x[i, 1] = b.words, min(1.0, b.linked / b.words)
        x[i, 6:] = known[p]
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    if len(found):
        # a page that marks its article leaves nothing to the other parts
        mine = (x[:, 6] > 0) & (x[:, 8] < 1) & (x[:, 9] < 1)
        x[:, 7] = mine.any()
    return x


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 1):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, float(y.mean()) if len(y) else 0.0))
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        whole = self._gini(y.sum(), len(y))
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, left = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(y) - least)]
            if len(cut):
                l = left[cut - 1]
                gain = whole - (self._gini(l, cut) + self._gini(left[-1] - l, len(y) - cut))
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), j, float(v[cut[k] - 1] + v[cut[k]]) / 2)
        _, j, limit = best
        if j >= 0:
            low = x[:, j] <= limit
            a = self._grow(x[low], y[low], depth - 1, least)
            b = self._grow(x[~low], y[~low], depth - 1, least)
            self.nodes[at] = (j, limit, a, b, self.nodes[at][4])
        return at

    @staticmethod
    def _gini(ones, n):
        return 2.0 * ones * (n - ones) / n

    def used(self) -> set[str]:
        """Names of the features that the tree splits on."""
        return {FEATURES[j] for j, *_ in self.nodes if j >= 0}

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            j, limit, a, b, value = self.nodes[node]
            if j < 0:
                out[rows] = value
            elif len(rows):
                low = x[rows, j] <= limit
                todo += [(a, rows[low]), (b, rows[~low])]
        return out


#: Names of parts beside an article, in the labelled table.
_BESIDE = (
    "ad ads advert advertisement sponsor sponsored promo promotion banner sidebar side-bar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar top-bar site-header page-header notice alert warning cookie cookie-notice consent gdpr popup modal overlay "
    "header newsletter subscribe subscription signup sign-up login share sharing social related recommended widget toolbar pagination pager copyright legal disclaimer search tags byline comments comment-list respond reply replies discussion reader-comments"
).split()
#: Those of readers' words, which may be marked as articles in their turn.
_READERS = "comment comments comment-list reader-comments replies discussion responses".split()
#: Names of the article or of parts of it.
_OWN = "content article-body article post entry story body-text main-content text prose post-content entry-content article-header section chapter note figure caption quote lead summary".split()
_INNER = ("<p>{0}</p>", "<p>{0}</p>", "<p>{0}</p>", "<h1>{0}</h1>", "<h2>{0}</h2>", "<blockquote>{0}</blockquote>", "<ul><li>{0}</li><li>{1}</li></ul>", "<p><b>{0}<br>", "<pre>{0}</pre>", "<div>{0}</div>", "<table><tr><td>{0}</td></tr></table>", '<p><a href="/y">{0}</a></p>', "<section><h3>{0}</h3><p>{1}</p></section>")
_TAGS = ("<nav>{0}</nav>", "<footer>{0}</footer>", "<aside>{0}</aside>", "<form>{0}</form>", "<header>{0}</header>", '<div role="navigation">{0}</div>', '<div role="complementary">{0}</div>', '<div role="contentinfo">{0}</div>', '<div role="banner">{0}</div>', '<div style="display:none">{0}</div>', "<div hidden>{0}</div>", "<dialog>{0}</dialog>")


def training_pages(n: int = 700, seed: int = 3) -> list[str]:
    """The labelled table: pages whose blocks start with ``+`` (article) or ``-`` (not).

    Half of the pages mark their article by an element, a quarter by a class, and a quarter
    have no mark at all, so that only lengths, links and neighbours tell: there a menu is
    short links in a row, and a short line is a heading where a long block follows it.
    """
    draw = random.Random(seed)
    sizes = (1, 1, 2, 3, 5, 8, 13, 25, 50, 100, 200)

    def words(sign: str, k: int | None = None) -> str:
        return sign + " ".join(["word"] * (k or draw.choice(sizes)))

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words("-", draw.randint(1, 4))}</a></li>' for _ in range(draw.randint(1, 8))) + "</ul>"

    def filling() -> str:
        return draw.choice(("{0}", "<p>{0}</p>", "<h3>{0}</h3><p>{1}</p>", "<p>{0}</p><p>{1}</p>", "{l}", "<p>{0}</p>{l}", "<div>{0}</div>")).format(words("-"), words("-"), l=links())

    def side(own_header: bool = False) -> str:
        if draw.random() < 0.4:
            return draw.choice([t for t in _TAGS if not (own_header and t.startswith("<header"))]).format(filling())
        name = draw.choice(_BESIDE) if draw.random() < 0.8 else draw.choice(_READERS)
        said = draw.choice(('class="{0}"', 'id="{0}"')).format(name)
        # readers' words may be articles, of that name or none
        body = "".join(f"<article{draw.choice(('', '', ' class=comment', ' class=reply', ' class=response'))}>{filling()}</article>" for _ in range(draw.randint(1, 3))) if name in _READERS and draw.random() < 0.5 else filling()
        return draw.choice(("<div {0}>{1}</div>", "<section {0}>{1}</section>", "<ul {0}>{1}</ul>")).format(said, body)

    def article() -> str:
        parts = []
        for _ in range(draw.randint(1, 8)):
            part = draw.choice(_INNER).format(words("+"), words("+"))
            if draw.random() < 0.2:
                part = f'<div class="{draw.choice(_OWN)}">{part}</div>'
            parts.append(part)
        return "".join(parts)

    pages = []
    for i in range(n):
        before, after = ("".join(side() for _ in range(draw.randint(0, 3))) for _ in range(2))
        if i % 4 == 3:
            lines = []
            for _ in range(draw.randint(1, 4)):
                if draw.random() < 0.6:
                    lines.append(f"<h2>{words('+', draw.randint(1, 8))}</h2>" if draw.random() < 0.5 else f"<div>{words('+', draw.randint(1, 8))}</div>")
                lines += [f"<{t}>{words('+', draw.randint(12, 200))}</{t}>" for t in draw.choices(("p", "div"), k=draw.randint(1, 3))]
            bare = "".join(f'<div><a href="/x">{words("-", draw.randint(1, 4))}</a></div>' for _ in range(draw.randint(2, 8)))
            tail = f"<div>{words('-', draw.randint(1, 6))}</div>" if draw.random() < 0.5 else bare
            body = f"<div>{bare if draw.random() < 0.7 else ''}{''.join(lines)}{tail if draw.random() < 0.7 else ''}</div>"
        else:
            if i % 4 == 2:
                name = draw.choice(_OWN)
                start, end = draw.choice(((f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"), (f'<section class="{name}">', "</section>")))
            else:
                start, end = draw.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<article class="post">', "</article>")))
            inner = article()
            marked = i % 4 < 2
            if marked and draw.random() < 0.15:
                inner = f"<header><h1>{words('+')}</h1></header>" + inner
            if draw.random() < 0.35:
                inner = inner + side(marked) if draw.random() < 0.5 else side(marked) + inner + article()
            body = start + inner + end
            if marked:  # text beside a marked article needs no name to be told
                before += f"<div><p>{words('-')}</p></div>" * draw.randint(0, 1)
                after += f"<div class=\"{draw.choice(_OWN)}\">{words('-')}</div>" * draw.randint(0, 1)
            if marked and draw.random() < 0.15:
                body = f'<div class="{draw.choice(_OWN)}"><p>{words("-")}</p>{body}<p>{words("-")}</p></div>'
            if draw.random() < 0.2:
                body = f'<div class="{draw.choice(_BESIDE)}-layout">{body}</div>' if marked else f'<div class="wrapper">{body}</div>'
        pages.append(f"<html><body>{before}{body}{after}</body></html>")
    return pages


@dataclasses.dataclass
class Classifier:
    speech: Speech
    tree: Tree

    def keeps(self, found: list[Block]) -> np.ndarray:
        return self.tree.predict(features(found, self.speech)) >= 0.5


def grown(pages: list[str]) -> Classifier:
    """The classifier of labelled pages (see ``training_pages``)."""
    found = [f for f in map(blocks, pages) if f]
    label = [[b.text[0] == "+" for b in f] for f in found]
    speech = Speech.counted([b.place for f in found for b in f], [y for ys in label for y in ys])
    return Classifier(speech, Tree(np.concatenate([features(f, speech) for f in found]), np.array([y for ys in label for y in ys], np.float64)))


@lru_cache(maxsize=1)
def default_classifier() -> Classifier:
    """That of the labelled table, grown anew (in about a second) in each worker."""
    return grown(training_pages())


def main_text(page: str | None, by: Classifier | None = None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = (by or default_classifier()).keeps(found)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, *, column: str = "html", by: Classifier | None = None) -> DataFrame:
    """``pages`` with ``column`` replaced by ``text`` (main text) and ``n_chars`` (code points)."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    pages = pages.select(*[f"`{c}`" for c in [*kept, column]])
    schema = pages.select(*[f"`{c}`" for c in kept]).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = by or default_classifier()
        for batch in batches:
            for part, texts in groups(batch, column):
                out = [main_text(t, use) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(run, schema)

"""Main text of web pages by gradient-boosted trees over DOM nodes.

1. A page becomes a tree of blocks, and of inline elements that carry a class or id.
   Every node is described by its tag, attribute words, depth, place, siblings and
   ancestors, and by text, links and tags below it.
2. Two boosted models (Spark ML) give the chance that a node holds main text, and
   that it holds anything else.  Their training pages are made of a bounded sample
   of the given ones: blocks of the sample are set anew in layouts drawn at random,
   so that what is main text is known.
3. Decoding is hierarchical: a node is kept, dropped or opened; what lies below a
   kept or dropped node follows it, and the most likely consistent choice for the
   whole tree is found by dynamic programming.

Pages are parsed, scored and decoded in one pass, without a shuffle.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.llm.common import in_small_batches, materialise

SAMPLE_PAGES = 200               # pages whose blocks make up the training pages, at most
SAMPLE_BLOCKS = 60               # blocks of one page used for them, at most
LAYOUTS = 6                      # training pages made of each
TREES, TREE_DEPTH, STEP_SIZE = 15, 6, 0.4
PROSE_WORDS = 8                  # a block with so many words can serve as prose
LEAST_CHANCE = 1e-3

# HTML's element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style template noscript head title textarea select button svg iframe object canvas audio "
                    "video datalist".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
_INLINE_KEPT = frozenset("b i u em strong small code sub sup abbr cite q mark time kbd samp var s del font".split())
#: What a start tag closes, up to the elements that bound it.
_CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
           "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
           "option": ("option", ()), "tbody": ("thead tbody tfoot", ("table",)), "tfoot": ("thead tbody tfoot", ("table",)),
           "body": ("head", ())}

# Words of attributes, as web authors use them.
_WORDS = {
    "menu": "nav|navbar|navigation|menu|breadcrumb|breadcrumbs|crumbs|toc|pagination|pager|tabs|topbar|skip|links",
    "advert": "ad|ads|adv|advert|advertisement|adbox|adslot|adunit|banner|promo|promotion|promoted|sponsor|sponsored|sponsors",
    "comment": "comment|comments|commentlist|disqus|reply|replies|respond|discussion|reviews|thread",
    "notice": "cookie|cookies|consent|gdpr|notice|alert|warning|popup|modal|overlay|disclaimer|toast|message|paywall",
    "aside": "sidebar|aside|widget|widgets|related|recommended|recommendations|trending|popular|share|sharing|social|"
             "newsletter|subscribe|signup|tags|teaser|teasers|author|bio|rail|more|also|archive|archives",
    "edge": "header|masthead|footer|foot|copyright|colophon|legal|logo|brand|credits|site|bottom|top",
    "form": "form|search|login|signin|register|input|field|contact|poll|survey",
    "main": "article|content|main|post|entry|story|body|text|prose|copy|page|blog|news|hentry|articlebody",
}
_TOKEN = {word: i for i, words in enumerate(_WORDS.values()) for word in words.split("|")}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LONG = [(word, i) for word, i in _TOKEN.items() if len(word) >= 7]

#: Tags as features: each group is a column.
_TAG_GROUPS = ["article main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header",
               "footer", "aside", "form fieldset", "table tbody thead tr", "td th", "blockquote pre figure figcaption",
               "a span", "#text"]
_GROUP_OF = {tag: i for i, group in enumerate(_TAG_GROUPS) for tag in group.split()}
_OTHER_GROUP = len(_TAG_GROUPS)
_BAD_TAGS = frozenset("nav header footer aside form fieldset".split())
_GOOD_TAGS = frozenset("article main".split())


def attribute_words(value: str) -> list[int]:
    """How often the words of a class, id or role belong to each group of ``_WORDS``."""
    hits = [0] * len(_WORDS)
    for part in _PART.findall(value):
        part = part.lower()
        at = _TOKEN.get(part)
        if at is None:                          # run together, as in "maincontent" or "articlecomments"
            at = next((i for word, i in _LONG if word in part), None)
        if at is not None:
            hits[at] += 1
    return hits


class Dom(HTMLParser):
    """The nodes of one page in document order, and its pieces of text.

    Missing end tags are implied, others without a start are ignored, and what
    is open at the end of the page is closed there.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = ["#page"]
        self.parent, self.depth, self.end = [-1], [0], [0]
        self.hits: list[list[int]] = [[0] * len(_WORDS)]
        self.above: list[list[int]] = [[0] * (len(_WORDS) + 2)]     # of all ancestors: words, good and bad tags
        self.inputs = [0]
        self.pieces: list[tuple[int, str, bool, bool]] = []         # node, text, break before it, in a link
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.open: Counter[str] = Counter()
        self.unseen = self.links = 0
        self.run: int | None = None
        self.gap = True
        self.feed(html)
        self.close()
        while len(self.stack) > 1:
            self._pop()
        self.end[0] = len(self.tag)

    def _node(self, tag: str, hits: list[int]) -> int:
        up = self.stack[-1][1]
        above = [a + h for a, h in zip(self.above[up], self.hits[up])] + [
            self.above[up][-2] + (self.tag[up] in _GOOD_TAGS), self.above[up][-1] + (self.tag[up] in _BAD_TAGS)]
        at = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.end.append(at + 1)
        self.hits.append(hits)
        self.above.append(above)
        self.inputs.append(0)
        return at

    def _pop(self) -> None:
        tag, node = self.stack.pop()
        self.open[tag] -= 1
        self.unseen -= tag in _UNSEEN
        self.links -= tag == "a"
        if node != self.stack[-1][1]:
            self.end[node] = len(self.tag)
            self.run = None
        if tag in _BLOCKS:
            self.gap = True

    def _close(self, tags: Iterable[str], bounds: Iterable[str]) -> None:
        """End the innermost open element of ``tags``, unless one of ``bounds`` is open inside it."""
        if not any(self.open[t] > 0 for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in bounds:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            self.gap |= tag in ("br", "hr")
            if tag == "input":
                self.inputs[self.stack[-1][1]] += 1
            return
        if tag in _CLOSES:
            closed, bounds = _CLOSES[tag]
            self._close(closed.split(), bounds)
        if tag in _BLOCKS:
            if tag not in ("html", "body", "option"):
                self._close(("head",), ())
                self._close(("p",), ("td", "th", "table", "button", "object"))
            if tag in ("html", "body") and self.open[tag]:
                return
            self.gap = True
        self.unseen += tag in _UNSEEN
        self.links += tag == "a"
        node = self.stack[-1][1]
        if not self.unseen:
            said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
            # html and body may be left out of a page, so they are no nodes.
            if tag in _BLOCKS - {"html", "body"} or (said and tag not in _BLOCKS | _INLINE_KEPT):
                node = self._node(tag, attribute_words(said) if said else [0] * len(_WORDS))
                self.run = None
        self.stack.append((tag, node))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)        # a slash at the end means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.gap = True
        if tag in _BLOCKS or tag in _UNSEEN:
            self._close((tag,), ())
        elif self.open[tag] > 0:
            for k in range(len(self.stack) - 1, 0, -1):
                name, node = self.stack[k]
                if name == tag and k == len(self.stack) - 1:
                    self._pop()
                    return
                if name in _BLOCKS or (name == tag and node != self.stack[k - 1][1]):
                    return
                if name == tag:                 # overlaps what is still open
                    del self.stack[k]
                    self.open[tag] -= 1
                    self.links -= tag == "a"
                    return

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if not data.strip():
            self.gap = True
            return
        if self.run is None:
            self.run = self._node("#text", [0] * len(_WORDS))
        self.pieces.append((self.run, data, self.gap, self.links > 0))
        self.gap = False


_STOPS = re.compile(r"[.!?;:](?=\s|$)|[,。，]")
_OWN = ("chars", "words", "stops", "linked", "tags", "paragraphs", "items", "long", "inputs", "pieces")


class Pages:
    """Trees of some pages, one after the other, with their features."""

    def __init__(self, htmls: Iterable[str]):
        tags: list[str] = []
        parent, depth, end, hits, above, inputs, page, text_of = [], [], [], [], [], [], [], []
        self.pieces: list[tuple[int, str, bool]] = []
        self.first: list[int] = []              # root of each page
        self.first_piece: list[int] = []
        own: list[tuple[int, int, int, int, int]] = []
        for number, html in enumerate(htmls):
            dom, base = Dom(html), len(tags)
            self.first.append(base)
            self.first_piece.append(len(self.pieces))
            # Text that is all there is in an element belongs to the element.
            children = np.bincount(np.array(dom.parent[1:], np.int64), minlength=len(dom.tag))
            spare = [t == "#text" and p > 0 and children[p] == 1 for t, p in zip(dom.tag, dom.parent)]
            place = np.concatenate([[0], np.cumsum(~np.array(spare))]) + base
            for k in range(len(dom.tag)):
                if not spare[k]:
                    tags.append(dom.tag[k])
                    parent.append(place[dom.parent[k]] if k else -1)
                    depth.append(dom.depth[k])
                    end.append(place[dom.end[k]])
                    hits.append(dom.hits[k])
                    above.append(dom.above[k])
                    inputs.append(dom.inputs[k])
                    page.append(number)
            for node, text, gap, linked in dom.pieces:
                node = dom.parent[node] if spare[node] else node
                at = int(place[node])
                words = text.split()
                chars = sum(map(len, words))
                own.append((at, chars, len(words), len(_STOPS.findall(text)), chars if linked else 0))
                self.pieces.append((at, text, gap))
        self.tags, self.page = tags, np.array(page, np.int64)
        self.parent, self.end = np.array(parent, np.int64), np.array(end, np.int64)
        n = len(tags)
        counts = np.zeros((n, len(_OWN)))
        if own:
            table = np.array(own, np.int64)
            for j in range(4):
                counts[:, j] = np.bincount(table[:, 0], table[:, j + 1], minlength=n)
            counts[:, 9] = np.bincount(table[:, 0], minlength=n)
        self.group = np.array([_GROUP_OF.get(t, _OTHER_GROUP) for t in tags], np.int64)
        counts[:, 4] = self.group != _GROUP_OF["#text"]
        counts[:, 5] = (self.group == _GROUP_OF["p"]) & (counts[:, 0] > 0)
        counts[:, 6] = self.group == _GROUP_OF["li"]
        counts[:, 7] = np.where((counts[:, 1] >= PROSE_WORDS) & (counts[:, 3] * 3 < counts[:, 0]), counts[:, 0], 0)
        counts[:, 8] = inputs
        self.own = counts
        self.features = self._describe(np.array(depth, float), np.array(hits, float).reshape(n, -1),
                                       np.array(above, float).reshape(n, -1)) if n else np.zeros((0, 0))

    def _below(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subtrees: a subtree is a range of nodes."""
        sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        return sums[self.end] - sums[:-1]

    def _describe(self, depth: np.ndarray, hits: np.ndarray, above: np.ndarray) -> np.ndarray:
        n = len(self.tags)
        below = self._below(self.own)
        chars, words, stops, linked, tags, paragraphs, items, long, inputs, pieces = below.T
        root = np.array(self.first, np.int64)[self.page]
        up = np.where(self.parent < 0, np.arange(n), self.parent)
        before = np.concatenate([[0], np.cumsum(self.own[:, 0])])
        total = np.maximum(chars[root], 1)
        start = (before[:-1] - before[root]) / total
        stop = (before[self.end] - before[root]) / total
        # Siblings: nodes in order of parent, then place.
        order = np.lexsort((np.arange(n), self.parent))
        same_before = np.concatenate([[False], self.parent[order][1:] == self.parent[order][:-1]])
        same_before[self.parent[order] < 0] = False
        same_after = np.concatenate([same_before[1:], [False]])
        first = np.maximum.accumulate(np.where(same_before, 0, np.arange(n)))
        siblings = np.bincount(first, minlength=n)[first]
        density = linked / np.maximum(chars, 1)

        def neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            v, left, right = values[order], np.full(n, -1.0), np.full(n, -1.0)
            left[order] = np.where(same_before, np.roll(v, 1), -1)
            right[order] = np.where(same_after, np.roll(v, -1), -1)
            return left, right

        place, count, alike = np.empty(n), np.empty(n), np.empty(n)
        place[order] = (np.arange(n) - first) / np.maximum(siblings - 1, 1)
        count[order] = siblings
        kind, which = np.unique(np.stack([self.parent, self.group], 1), axis=0, return_inverse=True)
        alike = np.bincount(which.ravel(), minlength=len(kind))[which.ravel()] / np.maximum(count, 1)
        size = np.log1p(chars)
        sides = [*neighbours(size), *neighbours(density)]
        groups = np.zeros((n, _OTHER_GROUP + 1))
        bad_tag = np.array([t in _BAD_TAGS for t in self.tags], float)
        marked = hits[:, :-1].sum(axis=1) + bad_tag             # as something else than main text, here or above
        below_marked = self._below(marked[:, None])[:, 0]
        path = marked + above[:, :len(_WORDS) - 1].sum(axis=1) + above[:, -1]
        groups[np.arange(n), self.group] = 1
        return np.column_stack([
            groups, hits, above, marked, path, below_marked, depth, size, np.log1p(words), density, stops / np.maximum(words, 1),
            chars / np.maximum(words, 1), chars / np.maximum(tags, 1), chars / np.maximum(pieces, 1), np.log1p(paragraphs),
            np.log1p(items), long / np.maximum(chars, 1), np.log1p(inputs), start, stop, chars / total,
            chars / np.maximum(chars[up], 1), place, np.log1p(count), alike, *sides, density[up], np.log1p(long[up]),
            self.own[:, 0] / np.maximum(chars, 1)])


# ---------------------------------------------------------------- training pages

_MAIN, _NOISE = "\ue000", "\ue001"      # mark the text of training pages; taken out before they are described


class _Layout:
    """A page drawn at random around some prose."""

    def __init__(self, draw: random.Random, prose: list[str], short: list[str]):
        self.draw, self.prose, self.short = draw, prose, short

    def attrs(self, *kinds: str, chance: float = 0.85) -> str:
        """A class or id with a word of ``kinds``, perhaps with one of another kind beside it."""
        if not kinds or self.draw.random() > chance:
            return ""
        words = [self.draw.choice(_WORDS[k].split("|")) for k in kinds]
        if self.draw.random() < 0.35:
            words.append(self.draw.choice(["inner", "box", "list", "item", "block", "area", "left", "x1", "container",
                                           self.draw.choice(_WORDS["main"].split("|"))]))
        return f' {self.draw.choice(["class", "class", "id"])}="{self.draw.choice(["-", " ", "_"]).join(words)}"'

    def text(self, mark: str, source: list[str], words: int | None = None) -> str:
        said = self.draw.choice(source)
        if words:
            some = said.split()
            at = self.draw.randrange(max(1, len(some) - words + 1))
            said = " ".join(some[at:at + words])
        some = said.split()
        for tag in self.draw.choice([(), (), ("a",), ("b",), ("em", "a"), ("a", "a", "span")]):
            at = self.draw.randrange(len(some) + 1)
            if some[at:at + 3]:                 # inline elements within the text
                some = [*some[:at], f"\0{tag}" + " ".join(some[at:at + 3]) + f"\1{tag}", *some[at + 3:]]
        said = escape(" ".join(some))
        return mark + re.sub("\0(a|b|em|span)", rf"<\1 href=x>{mark}", re.sub("\1(a|b|em|span)", rf"</\1>{mark}", said))

    def noise(self, words: int | None = None) -> str:
        return self.text(_NOISE, self.draw.choice([self.prose, self.short]), words)

    def link(self, words: int | None = None) -> str:
        return f'<a href="/x">{self.noise(words or self.draw.randint(1, 4))}</a>'

    def links(self) -> str:
        some = [self.link() for _ in range(self.draw.randint(2, 9))]
        return self.draw.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>", lambda: " | ".join(some),
                                 lambda: "".join(f"<div>{x}</div>" for x in some),
                                 lambda: "<p>" + " ".join(some) + "</p>"])()

    def wrap(self, tags: str, inner: str, *kinds: str, chance: float = 0.85) -> str:
        tag = self.draw.choice(tags.split())
        chance = chance if tag in _BAD_TAGS or (kinds == ("menu",) and "<a" in inner) else 1
        return f"<{tag}{self.attrs(*kinds, chance=chance)}>{inner}</{tag}>"

    def menu(self) -> str:
        return self.wrap("nav nav div ul", self.links(), "menu", chance=0.7)

    def header(self) -> str:
        inner = self.draw.choice([f"<h1>{self.noise(3)}</h1>", f"<h1>{self.link(2)}</h1>", self.link(2), f"<p>{self.link(1)}</p>"])
        inner += self.draw.choice(["", "", f"<p>{self.noise(8)}</p>", self.menu()])
        return self.wrap("header div", inner, "edge")

    def footer(self) -> str:
        inner = self.draw.choice(["", "&copy; "]) and f"{_NOISE}&copy; 2020 "
        inner += self.draw.choice([self.noise(12), f"<p>{self.noise()}</p>", self.links()])
        return self.wrap("footer div", inner, "edge")

    def advert(self) -> str:
        return self.wrap("div div aside section ins p", self.draw.choice([self.noise(), self.noise(12), self.link(6), f"<p>{self.noise(10)}</p>"]), "advert")

    def notice(self) -> str:
        return self.wrap("div section p aside", self.draw.choice([self.noise(20), f"<p>{self.noise()}</p>{self.link(2)}"]), "notice")

    def form(self) -> str:
        return f"<form{self.attrs('form', chance=0.4)}><label>{self.noise(3)}</label><input><p>{self.noise(12)}</p></form>"

    def aside(self) -> str:
        inner = "".join(self.draw.choice([lambda: f"<h3>{self.noise(3)}</h3>", self.links, lambda: f"<p>{self.noise()}</p>"])()
                        for _ in range(self.draw.randint(1, 4)))
        return self.wrap("aside div section", inner, "aside")

    def comments(self) -> str:
        each = self.draw.choice(["article", "div", "li", "section"])
        own = self.draw.choice([self.attrs("comment", chance=0.8), ""])
        some = "".join(f"<{each}{own}>" + self.draw.choice(["", f"<b>{self.noise(2)}</b>", f"<h4>{self.noise(2)}</h4>"]) +
                       f"<p>{self.noise()}</p></{each}>" for _ in range(self.draw.randint(1, 5)))
        return self.wrap("ol ul" if each == "li" else "section div", self.draw.choice(["", f"<h3>{self.noise(2)}</h3>"]) + some,
                         "comment")

    def between(self) -> str:
        """What stands beside or inside the main text."""
        return self.draw.choice([self.advert, self.aside, self.notice, self.form, self.menu, self.links])()

    def paragraph(self) -> str:
        said = self.text(_MAIN, self.prose, self.draw.choice([None, None, None, self.draw.randint(1, 6), 25]))
        kind = self.draw.random()
        if kind < 0.6:
            return f"<p>{self.draw.choice(['', '', '<b>', '<a href=x>'])}{said}{self.draw.choice(['</p>', '</p>', '', '<br>'])}"
        if kind < 0.68:
            return f"<h2>{self.text(_MAIN, self.prose, 4)}</h2><p>{said}</p>"
        if kind < 0.76:
            return self.draw.choice(["<ul>", "<ol>"]) + "".join(
                f"<li>{self.text(_MAIN, self.prose, self.draw.randint(2, 15))}</li>" for _ in range(self.draw.randint(1, 4))) + "</ul></ol>"
        if kind < 0.84:
            return f"<blockquote><p>{said}</p></blockquote>"
        if kind < 0.9:
            return f"<table><tr><td>{said}</td><td>{self.text(_MAIN, self.prose, 3)}</td></tr></table>"
        return f"<div>{said}</div>"

    def article(self) -> str:
        inside = [self.paragraph() for _ in range(self.draw.choice([1, 1, 2, 3, 4, 6, 9, 14]))]
        if self.draw.random() < 0.2:
            inside = [self.text(_MAIN, self.prose) + "<br><br>" for _ in inside]
        head = f"<h1>{self.text(_MAIN, self.prose, self.draw.randint(1, 9))}</h1>"
        head = self.draw.choice(["", head, head, f"<header>{head}</header>"])
        if self.draw.random() < 0.4:
            inside.insert(self.draw.randint(0, len(inside)), self.between())
        if self.draw.random() < 0.15:
            inside.append(self.comments())
        out = self.draw.choice(["article", "article", "main", "div", "div", "section", "td"])
        attrs = self.attrs("main", chance=0.75 if out in ("div", "section", "td") else 0.4)
        out = f"<{out}{attrs}>{head}{''.join(inside)}</{out}>"
        return f"<table><tr>{out}</tr></table>" if out.startswith("<td") else out

    def page(self) -> str:
        maybe = lambda f, chance: f() if self.draw.random() < chance else ""
        parts = [maybe(self.notice, 0.2), maybe(self.header, 0.5), maybe(self.menu, 0.7), maybe(self.advert, 0.4),
                 maybe(self.aside, 0.25), self.article(), maybe(self.comments, 0.3), maybe(self.aside, 0.3),
                 maybe(self.advert, 0.2), maybe(self.form, 0.25), maybe(self.links, 0.1), maybe(self.footer, 0.85),
                 maybe(self.notice, 0.1)]
        if self.draw.random() < 0.4:            # a wrapper around the middle of the page
            a, b = self.draw.randint(0, 5), self.draw.randint(6, len(parts))
            parts[a:b] = [f'<div{self.attrs("main", chance=0.5)}>' + "".join(parts[a:b]) + "</div>"]
        body = "".join(parts)
        for _ in range(self.draw.choice([0, 0, 1, 2])):
            body = f'<div{self.draw.choice(["", " class=wrap", " id=page", " class=container"])}>{body}</div>'
        end = self.draw.choice(["</body></html>", "</body></html>", ""])
        return f"<!DOCTYPE html><html><head><title>{self.noise(4)}</title></head><body>{body}{end}"


def training_pages(html: str, seed: str, layouts: int = LAYOUTS) -> list[str]:
    """Pages drawn around the blocks of a page, with marked text."""
    pages = Pages([html.replace(_MAIN, "").replace(_NOISE, "")])
    draw = random.Random(seed)
    blocks: dict[int, list[str]] = {}
    for node, text, _ in pages.pieces:
        blocks.setdefault(node, []).append(text)
    said = [(node, " ".join(" ".join(x).split())) for node, x in blocks.items()]
    said = draw.sample(said, min(len(said), SAMPLE_BLOCKS))
    prose = [t for node, t in said if pages.own[node, 7] > 0] or [t for _, t in said] or ["text"]
    short = [t for node, t in said if pages.own[node, 7] == 0] or prose
    return [_Layout(draw, prose, short).page() for _ in range(layouts)]


def described(htmls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the nodes of marked pages, and whether main and other text stands below them."""
    marked = Pages(htmls)
    truth = np.zeros((len(marked.tags), 2))
    for node, text, _ in marked.pieces:
        truth[node] += (_MAIN in text, _NOISE in text)
    below = marked._below(truth) > 0
    plain = Pages([h.replace(_MAIN, "").replace(_NOISE, "") for h in htmls])
    if len(plain.tags) != len(marked.tags):      # a block of marks alone
        return np.zeros((0, plain.features.shape[1])), np.zeros(0), np.zeros(0)
    some = below.any(axis=1)
    return plain.features[some], below[some, 0], below[some, 1]


def _train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            for made in training_pages(html.as_py(), str(page_id)):
                x, main, noise = described([made])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), pa.array(main.astype(float)), pa.array(noise.astype(float))],
                    names=["x", "main", "noise"])


# ---------------------------------------------------------------- model

class Boosted:
    """Trees of a fitted Spark ML model as arrays, to score nodes where the pages are."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray, roots: list[int],
                 weights: list[float]):
        self.feature, self.threshold, self.left, self.value = feature, threshold, left, value
        self.roots, self.weights = roots, weights

    @classmethod
    def of(cls, model) -> Boosted:
        feature, threshold, left, value, roots = [], [], [], [], []

        def add(count: int) -> int:
            at = len(feature)
            for column, empty in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
                column += [empty] * count
            return at

        for tree in model.trees:
            roots.append(add(1))
            todo = [(roots[-1], tree._java_obj.rootNode())]
            while todo:
                at, node = todo.pop()
                value[at] = node.prediction()
                if node.subtreeDepth():
                    feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
                    left[at] = add(2)
                    todo += [(left[at], node.leftChild()), (left[at] + 1, node.rightChild())]
        return cls(*map(np.array, (feature, threshold, left, value)), roots, list(model.treeWeights))

    def chance(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            margin += weight * self.value[at]
        return np.clip(1 / (1 + np.exp(-2 * margin)), LEAST_CHANCE, 1 - LEAST_CHANCE)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES,
        trees: int = TREES) -> tuple[Boosted, Boosted] | None:
    """Models of main and of other text, from at most ``sample_pages`` pages; None if there is no page to learn from."""
    some = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(html_col).cast("string").alias("html")).where(
        "html <> ''").orderBy(F.xxhash64("page_id", "html"), "page_id", "html").limit(sample_pages)
    rows = materialise(in_small_batches(some).mapInArrow(_train, "x array<double>, main double, noise double"), "page-nodes")
    if rows.isEmpty():
        return None
    rows = rows.select(array_to_vector("x").alias("features"), "main", "noise").coalesce(4).persist()   # small, by its bounds
    try:
        return tuple(Boosted.of(boosting(label, trees).fit(rows)) for label in ("main", "noise"))
    finally:
        rows.unpersist()


def boosting(label: str, trees: int = TREES) -> GBTClassifier:
    return GBTClassifier(labelCol=label, maxIter=trees, maxDepth=TREE_DEPTH, stepSize=STEP_SIZE, maxBins=64, seed=5)


def decode(parent: np.ndarray, leaf: np.ndarray, main: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the most likely choice in which no node contradicts those above or below it.

    ``parent`` comes before its children; -1 for roots.  A kept node holds main text
    only, a dropped one none, an opened one both, and only inner nodes open.
    """
    keep, drop = np.log(main) + np.log1p(-noise), np.log1p(-main) + np.log(noise)
    opened = np.where(leaf, -np.inf, np.log(main) + np.log(noise))
    up, k, d, o = parent.tolist(), keep.tolist(), drop.tolist(), opened.tolist()
    choice = [0] * len(up)
    for v in range(len(up) - 1, -1, -1):
        best = max(k[v], d[v], o[v])
        choice[v] = 1 if k[v] == best else 2 if o[v] == best else 0
        if up[v] >= 0:
            k[up[v]] += k[v]
            d[up[v]] += d[v]
            o[up[v]] += best
    kept = np.zeros(len(up), bool)
    for v, p in enumerate(up):
        if p >= 0 and choice[p] != 2:
            choice[v] = choice[p]
        kept[v] = choice[v] == 1
    return kept


def main_texts(htmls: list[str], models: tuple[Boosted, Boosted]) -> list[str]:
    """Main text of each page: blocks in page order, white space as one space."""
    pages = Pages(htmls)
    chars = pages._below(pages.own)[:, 0]
    # Nodes without text take no part.
    some = np.flatnonzero(chars > 0)
    place = np.full(len(chars) + 1, -1)
    place[some] = np.arange(len(some))
    inner = np.zeros(len(some), bool)
    up = place[pages.parent[some]]
    inner[up[up >= 0]] = True
    main, noise = (m.chance(pages.features[some]) if len(some) else np.zeros(0) for m in models)
    kept = decode(up, ~inner, main, noise)
    out = []
    for lo, hi in zip(pages.first_piece, [*pages.first_piece[1:], len(pages.pieces)]):
        said = [(" " if gap else "") + text for node, text, gap in pages.pieces[lo:hi] if kept[place[node]]]
        out.append(" ".join("".join(said).split()))
    return out


PAGES_AT_ONCE = 64


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            models: tuple[Boosted, Boosted] | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row: the page's main text and its code points.

    A null, empty or textless page has the empty text.  Repeated rows, null ids and
    null urls come back as they are; other columns are ignored.  ``models`` as of
    ``fit``, by default fitted on ``pages``.
    """
    models = models or fit(pages, id_col, html_col)
    if models is None:
        return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.lit("").alias("text"),
                            F.lit(0).cast("long").alias("n_chars"))
    shared = pages.sparkSession.sparkContext.broadcast(models)      # trees x 2 ** depth numbers
    rows = in_small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                                          F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(at, PAGES_AT_ONCE)
                texts = main_texts([h or "" for h in batch.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

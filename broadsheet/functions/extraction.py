"""An article's text from its page: boilerplate removal, scored elements, a cascade of places of which the first good text counts, and markup cut to a length.

One pass over the parsed page numbers its elements and lists its strings; an element is a run of that list. The strings become one tidied text, of which an element's is a part, and whether it is good is found from counts over the
whole, so that nested elements never read the same text over and over.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html as H
from .scoring import ERROR_TEXT, METADATA, NAV_WORDS, SPAM
from .text import FURNITURE

# Where an article's text is looked for, in order; words in classes and ids; tags that go.
SELECTORS = (
    ".mb-14", '[itemprop="articleBody"]', '[itemprop="text"]', "article", "main", ".article-content", ".post-content", ".entry-content", ".content", ".main-content", ".page-content", ".story-content",
    ".news-content", ".blog-content", "#content", "#main-content", "#article-content", "#post-content", "#story", "#article", ".container .content", ".wrapper .content", 'div[role="main"]', '[role="article"]',
)
BOILERPLATE_TAGS = ("script", "style", "nav", "aside", "footer", "header")
BOILERPLATE_NAMES = (
    "nav", "navigation", "menu", "sidebar", "aside", "ad", "advertisement", "promo", "banner", "social", "share", "sharing", "follow", "related", "recommended", "popular", "comments", "comment",
    "discussion", "widget", "plugin", "gadget",
)
GOOD_NAMES = ("content", "article", "post", "entry", "story", "news", "text", "body")
BAD_NAMES = ("nav", "sidebar", "footer", "header", "ad", "comment", "social")
TAG_POINTS = {"article": 4.0, "section": 1.0, "div": 1.0, "p": 0.5}
BREAKS = (". ", "! ", "? ", "\n\n", "\n", ", ", " ")
INNER_TAGS = ("script", "style", "nav", "aside")

_FURNITURE = [re.compile(rf"(?<!\w){p}(?!\w)\s*", re.IGNORECASE) for p in FURNITURE]
#: The same, with what is taken out besides the blanks behind it as a group; blanks that go before punctuation.
_FURNITURE_PARTS = [re.compile(rf"(?<!\w)({p})(?!\w)\s*", re.IGNORECASE) for p in FURNITURE]
_BLANK_BEFORE = re.compile(r"\s+([.,:;!?])")
_SPAM, _METADATA = [re.compile(p) for p in SPAM], [re.compile(p) for p in METADATA]
_CYRILLIC, _LATIN = re.compile("[а-яёА-ЯЁ]"), re.compile("[a-zA-Z]")


def tidy(text: str) -> str:
    """As `text.clean_text`: white space collapsed, furniture words removed, no blanks before punctuation."""
    text = re.sub(r"\s+", " ", text)
    for pattern in _FURNITURE:
        text = pattern.sub("", text)
    return re.sub(r"\s+([.,:;!?])", r"\1", text).strip()


def is_good(text: str | None, full_article: bool = False, least: int = 200) -> bool:
    """As `scoring.is_good_content`."""
    if not text:
        return False
    low, words = text.strip().lower(), text.split()
    if len(low) < (max(100, least // 2) if full_article else least) or not 0.05 <= len(words) / len(text) <= 0.5:
        return False
    sentences = [n for n in (len(s.strip()) for s in text.split(".")) if n > 10]
    if len(sentences) < (1 if full_article else 2) or sum(sentences) < 15 * len(sentences) or len(words) < 10:
        return False
    lowered = [w.lower() for w in words]
    if len({w for w in lowered if len(w) > 3}) < 0.3 * len(words):
        return False
    if sum(any(x in w for x in NAV_WORDS) for w in lowered) > len(words) * (0.15 if full_article else 0.1):
        return False
    long = Counter(w for w in lowered if len(w) > 4)
    return not (long and max(long.values()) > len(words) * 0.15) and not any(x in low for x in ERROR_TEXT)


def is_poor(text: str) -> bool:
    """Whether the first objection that the smart filter has to an extracted text is that it is metadata."""
    low = text.strip().lower()
    if not 50 <= len(text.strip()) <= 50_000 or len(text) > 50_000:
        return False
    cyrillic, latin = len(_CYRILLIC.findall(text)), len(_LATIN.findall(text))
    if cyrillic + latin >= 50 and 0.1 < cyrillic / (cyrillic + latin) < 0.3:
        return False
    titled = f"extracted content {text.lower()}"
    if any(p.search(titled) for p in _SPAM):
        return False
    words = low.split()
    repetitive = len(low) < 100 and len(words) > 5 and len(set(words)) < 0.6 * len(words)
    return repetitive or any(p.search(low) for p in _METADATA)


def _names(node: H.Node) -> str:
    return f"{' '.join(node.attrs.get('class', '').split())} {node.attrs.get('id', '')}".lower()


class Layer:
    """Strings of a page that are read together, as one tidied text, of which an element's text is a part.

    What decides whether a part is good text is counted once for the whole: words, dots, navigation words, error texts. So each element is judged from differences of
    counts, whatever it holds, and from the words of the elements inside it. Where something that tidying takes out, or a word, goes over an end of an element, that element's text is made by itself.
    """

    def __init__(self, strings: list[str]):
        strings = [re.sub(r"\s+", " ", x) for x in strings]
        at, size = [], 0
        for x in strings:
            at.append(size)
            size += len(x) + 1
        self.strings, text, ends = strings, " ".join(strings), [*at, max(size - 1, 0)]
        self.crossed = [False] * len(ends)
        folded = text.replace("İ", "i").replace("ı", "i").casefold()  # as patterns fold
        for pattern in [p for phrase, p in zip(FURNITURE, _FURNITURE_PARTS, strict=True) if all(w in folded for w in phrase.lower().split())]:
            text, ends = self._without(text, ends, [(m.start(), m.end(1), m.end()) for m in pattern.finditer(text)])
        text, ends = self._without(text, ends, [(m.start(), m.start(), m.start(1)) for m in _BLANK_BEFORE.finditer(text)])
        self.text, self.ends = text, ends
        self.low = text.lower()
        self.even = len(self.low) == len(text)  # else places in the one are not those in the other
        apart = text.split(" ")  # all white space is single blanks by now
        after = itertools.accumulate((len(w) + 1 for w in apart), initial=0)
        places = [(a, w) for a, w in zip(after, apart, strict=False) if w]
        self.starts, self.stops = [a for a, _ in places], [a + len(w) for a, w in places]
        self.words = [w.lower() for _, w in places]
        there = [x for x in NAV_WORDS if x in self.low]
        leading = {w: any(x in w for x in there) for w in set(self.words)} if there else dict.fromkeys(self.words, False)
        self.navigation = list(itertools.accumulate(map(leading.__getitem__, self.words), initial=0))
        self.dots = [m.start() for m in re.finditer(r"\.", text)]
        pieces = [len(text[a + 1 : b].strip()) for a, b in itertools.pairwise(self.dots)]
        self.sentences = list(itertools.accumulate((n > 10 for n in pieces), initial=0))
        self.spoken = list(itertools.accumulate((n if n > 10 else 0 for n in pieces), initial=0))
        self.commas = [m.start() for m in re.finditer(",", text)]
        self.errors = [[m.start() for m in re.finditer(f"(?={re.escape(x)})", self.low)] for x in ERROR_TEXT]

    def _without(self, text: str, ends: list[int], gone: list[tuple[int, int, int]]) -> tuple[str, list[int]]:
        """The text without the parts from first to last; ends where the middle goes beyond an end of strings are marked."""
        if not gone:
            return text, ends
        out, moved, at, k, lost = [], [], 0, 0, 0
        for first, middle, last in gone:
            while k < len(ends) and ends[k] <= first:
                moved.append(ends[k] - lost)
                k += 1
            while k < len(ends) and ends[k] < last or k < len(ends) and ends[k] == last:
                self.crossed[len(moved)] |= ends[k] < middle
                moved.append(first - lost)
                k += 1
            out.append(text[at:first])
            lost += last - first
            at = last
        moved.extend(e - lost for e in ends[k:])
        return "".join([*out, text[at:]]), moved

    def part(self, first: int, last: int) -> tuple[int, int] | None:
        """Where the text of strings from first to before last is, without blanks around it; None if it is no part of the whole."""
        if self.crossed[first] or self.crossed[last]:
            return None
        a, b = self.ends[first], self.ends[last]
        while a < b and self.text[a].isspace():
            a += 1
        while b > a and self.text[b - 1].isspace():
            b -= 1
        return a, b

    def of(self, first: int, last: int) -> str:
        place = self.part(first, last)
        return tidy(" ".join(self.strings[first:last])) if place is None else self.text[slice(*place)]

    def good(self, runs: list[tuple[int, int]]) -> list[bool]:
        """`is_good` of the texts of these runs of strings, of which any two are apart or one in the other."""
        out, judged = [False] * len(runs), []
        for k, (first, last) in enumerate(runs):
            place = self.part(first, last)
            if place is None or not self.even:
                out[k] = is_good(self.of(first, last))
                continue
            a, b = place
            i, j = bisect_left(self.starts, a), bisect_right(self.stops, b)
            if i and self.stops[i - 1] > a or j < len(self.starts) and self.starts[j] < b:  # a word goes over its end
                out[k] = is_good(self.text[a:b])
            elif self._likely(a, b, i, j):
                judged.append((i, j, k))
        for (i, j, k), (distinct, most) in self._words(judged):
            out[k] = distinct >= 0.3 * (j - i) and not (most and most > (j - i) * 0.15)
        return out

    def _likely(self, a: int, b: int, i: int, j: int) -> bool:
        """All conditions of `is_good` but those on how often words occur."""
        n = j - i
        if b - a < 200 or n < 10 or not 0.05 <= n / (b - a) <= 0.5 or self.navigation[j] - self.navigation[i] > n * 0.1:
            return False
        d, e = bisect_left(self.dots, a), bisect_left(self.dots, b)
        if d == e:
            return False  # one sentence
        around = [len(self.text[a : self.dots[d]].strip()), len(self.text[self.dots[e - 1] + 1 : b].strip())]
        count = self.sentences[e - 1] - self.sentences[d] + sum(x > 10 for x in around)
        if count < 2 or self.spoken[e - 1] - self.spoken[d] + sum(x for x in around if x > 10) < 15 * count:
            return False
        return not any((at := bisect_left(places, a)) < len(places) and places[at] + len(x) <= b for x, places in zip(ERROR_TEXT, self.errors, strict=True))

    def _words(self, runs: list[tuple[int, int, int]]):
        """Of each run of words, how many different ones are longer than three letters, and how often the most frequent one of more than four occurs. Counts of runs inside are taken over by the run around them, the smaller into the larger."""
        held: list[tuple[int, int, dict[str, int], int]] = []
        for run in sorted(runs, key=lambda r: (r[1], -r[0])):
            first, last, _ = run
            inner = []
            while held and held[-1][0] >= first:
                inner.append(held.pop())
            counts, most = {}, 0
            if inner:
                largest = max(inner, key=lambda x: len(x[2]))
                _, _, counts, most = largest
                for x in inner:
                    if x is not largest:
                        most = self._add(counts, x[2].items(), most)
            at = first
            for a, b, _, _ in reversed(inner):
                most = self._add(counts, ((w, 1) for w in self.words[at:a]), most)
                at = b
            most = self._add(counts, ((w, 1) for w in self.words[at:last]), most)
            held.append((first, last, counts, most))
            yield run, (len(counts), most)

    @staticmethod
    def _add(counts: dict[str, int], more, most: int) -> int:
        for w, n in more:
            if len(w) > 3:
                now = counts[w] = counts.get(w, 0) + n
                if len(w) > 4 and now > most:
                    most = now
        return most


class Page:
    """A parsed page with its elements in order. Scripts, styles, navigation and asides are layers of their own: an element's text is a run of the strings of the layer that it is in."""

    def __init__(self, root: H.Node):
        self.root, self.nodes, self.at = root, [], {}
        self.runs: list[list[int]] = []  # of each element: its layer, its first string there, the one after its last, the element after it
        self.paragraphs, self.linked = [0], [0]
        self.chars = [0]  # of the strings of all layers, in order
        self.all_runs: list[list[int]] = []
        strings: dict[int, list[str]] = {-1: []}
        self._layers: dict[int, Layer] = {}
        stack: list = [(root, -1)]
        while stack:
            x, inner = stack.pop()
            if x is None:  # the end of an element
                self.runs[inner][2:] = [len(strings[self.runs[inner][0]]), len(self.nodes)]
                self.all_runs[inner].append(len(self.chars) - 1)
            elif isinstance(x, str):
                if x.strip():
                    strings[inner].append(x.strip())
                    self.chars.append(self.chars[-1] + len(x.strip()))
            else:
                number = len(self.nodes)
                self.at[id(x)] = number
                self.nodes.append(x)
                if x.tag in INNER_TAGS:
                    inner = number
                    strings[inner] = []
                self.runs.append([inner, len(strings[inner])])
                self.all_runs.append([len(self.chars) - 1])
                self.paragraphs.append(self.paragraphs[-1] + (x.tag == "p"))
                stack.append((None, number))
                stack.extend((c, inner) for c in reversed(x.children))
        self._strings = strings
        for node, (first, last) in zip(self.nodes, self.all_runs, strict=True):
            self.linked.append(self.linked[-1] + (self.chars[last] - self.chars[first] if node.tag == "a" else 0))

    def layer(self, number: int) -> Layer:
        if number not in self._layers:
            self._layers[number] = Layer(self._strings[number])
        return self._layers[number]

    def text(self, node: H.Node) -> str:
        """An element's strings without those in scripts, styles, navigation and asides inside it."""
        layer, first, last, _ = self.runs[self.at[id(node)]]
        return self.layer(layer).of(first, last)

    def length(self, node: H.Node) -> int:
        layer, first, last, _ = self.runs[self.at[id(node)]]
        place = self.layer(layer).part(first, last)
        return len(self.text(node)) if place is None else place[1] - place[0]

    def commas(self, node: H.Node) -> int:
        layer, first, last, _ = self.runs[self.at[id(node)]]
        held = self.layer(layer)
        place = held.part(first, last)
        return self.text(node).count(",") if place is None else bisect_left(held.commas, place[1]) - bisect_left(held.commas, place[0])

    def good(self, nodes: list[H.Node]) -> dict[int, bool]:
        """Whether the texts of these elements are good, by `id` of the element."""
        by_layer: dict[int, list[tuple[int, tuple[int, int]]]] = {}
        for node in {id(n): n for n in nodes}.values():
            layer, first, last, _ = self.runs[self.at[id(node)]]
            by_layer.setdefault(layer, []).append((id(node), (first, last)))
        out = {}
        for layer, held in by_layer.items():
            runs = list(dict.fromkeys(r for _, r in held))
            found = dict(zip(runs, self.layer(layer).good(runs), strict=True))
            out |= {n: found[r] for n, r in held}
        return out

    def selected(self) -> tuple[str, str] | None:
        """The first good text of all elements of the selectors in order, and its selector."""
        hits = H.select_all(self.root, SELECTORS)
        good = self.good([n for found in hits.values() for n in found])
        return next(((self.text(n), selector) for selector in SELECTORS for n in hits[selector] if good[id(n)]), None)

    def score(self, node: H.Node, size: int) -> float:
        number, names = self.at[id(node)], _names(node)
        paragraphs = self.paragraphs[self.runs[number][3]] - self.paragraphs[number + 1]
        score = 3.0 if size > 500 else 2.0 if size > 200 else 1.0 if size > 100 else 0.0
        score += TAG_POINTS.get(node.tag, 0.0) + 2 * sum(x in names for x in GOOD_NAMES) - 3 * sum(x in names for x in BAD_NAMES) + min(paragraphs * 0.5, 3.0)
        return max(0.0, score)

    def candidates(self, most: int = 5) -> list[tuple[float, str]]:
        """The best scored paragraphs, blocks, articles and sections with more than fifty characters; of equals, those before."""
        found = [(self.score(n, size), n) for n in self.nodes if n.tag in ("p", "div", "article", "section") and (size := self.length(n)) > 50]
        found.sort(key=lambda x: -x[0])
        return [(score, self.text(node)) for score, node in found[:most]]

    def densest(self) -> str | None:
        """The element whose paragraphs have most text and commas and fewest links, with neighbours that have half as many points."""
        points: dict[int, float] = {}
        for node in self.nodes:
            if node.tag in ("p", "td", "pre") and node.parent is not None and (size := self.length(node)) >= 25:
                gain = 1 + self.commas(node) + min(size / 100, 3)
                for up, share in ((node.parent, 1.0), (node.parent.parent, 0.5)):
                    if up is not None and id(up) in self.at:
                        points[self.at[id(up)]] = points.get(self.at[id(up)], 0.0) + share * gain
        if not points:
            return None

        def weight(n: int) -> float:
            first, last = self.all_runs[n]
            return points[n] * (1 - (self.linked[self.runs[n][3]] - self.linked[n + 1]) / max(self.chars[last] - self.chars[first], 1))

        best = max(points, key=lambda n: (weight(n), -n))
        parent = self.nodes[best].parent
        near = [c for c in (parent.children if parent is not None else [self.nodes[best]]) if isinstance(c, H.Node)]
        parts = [self.text(c) for c in near if self.at[id(c)] == best or points.get(self.at[id(c)], 0) >= 0.5 * points[best]]
        return tidy(" ".join(p for p in parts if p))


def without_boilerplate(markup: str | None) -> str:
    """The text of a page without scripts, navigation, asides, headers and footers, comments, and elements of whose classes and ids one has a boilerplate word in it."""
    out, stack = [], [H.parse(markup or "")]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip():
                out.append(x.strip())
        elif x.tag not in BOILERPLATE_TAGS:
            names = _names(x)
            if not any(p in names for p in BOILERPLATE_NAMES):
                stack.extend(reversed(x.children))
    return tidy(" ".join(out))


def extracted(markup: str | None, learned: str | None = None) -> tuple[str | None, str | None]:
    """(content, strategy): the first good text of the learned selector's first element, all elements of the selectors in order, the densest element, JSON-LD, the page's description, the best scored elements one by one
    and the first three of them together. A place whose text is not good is passed over; so are the first three places if their text is metadata."""
    root = H.parse(markup or "")
    page = Page(root)
    if learned:
        hit = H.select(root, learned)
        if hit and is_good(text := page.text(hit[0]), True) and not is_poor(text):
            return text, "learned"
    if (found := page.selected()) and not is_poor(found[0]):
        return found[0], f"selector:{found[1]}"
    if is_good(text := page.densest()) and not is_poor(text):
        return text, "readability"
    for x in H.json_ld(root):
        if isinstance(body := x.get("articleBody"), str) and is_good(body):
            return body, "json-ld"
    if is_good(text := H.meta(root, "og:description")):
        return text, "open-graph"
    best = page.candidates()
    for _, text in best:
        if is_good(text):
            return text, "scored"
    text = " ".join(t for score, t in best[:3] if score > 1.0)
    return (text, "combined") if is_good(text) else (None, None)


class _Open(HTMLParser):
    """Which tags a piece of markup leaves open."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in H.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass


def shortened(markup: str, most: int) -> str:
    """Markup of at most `most` characters as it is; else cut at the last sentence end, line break, comma or blank before most - 50 if that is past half, with '...' and its open tags closed. A tag that the cut would
    go through is left out."""
    if len(markup) <= most:
        return markup
    end = max(most - 50, 0)
    for mark in BREAKS:
        at = markup.rfind(mark, 0, end)
        if at > most // 2:
            end = at + len(mark)
            break
    head = markup[:end]
    if head.rfind("<") > head.rfind(">"):
        head = head[: head.rfind("<")]
    parser = _Open()
    parser.feed(head)
    return head + "..." + "".join(f"</{tag}>" for tag in reversed(parser.open))


@F.pandas_udf(T.BooleanType())
def good(text: pd.Series) -> pd.Series:
    """`is_good` of whole columns: one pass a text, where the same test as an expression (`scoring.is_good_content`) reads it anew for each of its eight conditions."""
    return text.map(is_good).astype(bool)


CONTENT = T.StructType([T.StructField("content", T.StringType()), T.StructField("strategy", T.StringType())])


@F.pandas_udf(CONTENT)
def content(markup: pd.Series, learned: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extracted(m, s) for m, s in zip(markup, learned, strict=True)], columns=CONTENT.names)


@F.pandas_udf(T.StringType())
def main_text(markup: pd.Series) -> pd.Series:
    return markup.map(without_boilerplate)


SCORED = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(SCORED)
def scored(markup: pd.Series) -> pd.Series:
    return markup.map(lambda m: [{"score": s, "text": t} for s, t in Page(H.parse(m or "")).candidates()])


def short_markup(most: int):
    @F.pandas_udf(T.StringType())
    def run(markup: pd.Series) -> pd.Series:
        return markup.map(lambda m: None if m is None else shortened(m, most))

    return run

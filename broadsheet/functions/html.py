"""Markup: one parse a page by the standard library, with a small selector matcher, behind Arrow UDFs.

Selectors: tag, .class, #id, [attr], [attr=value], [attr*=value], several of these on one element, and descendants
separated by blanks; a comma list is tried in order.
"""

from __future__ import annotations

import html as entities
import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "blockquote", "ul", "ol", "table", "figure", "header", "footer", "nav", "main", "aside"}
CHAT_TAGS = {"b", "strong", "i", "em", "u", "s", "code", "pre", "a"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)

    def walk(self):
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in SILENT:
                if x.tag in BLOCKS:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(x.children))
        return re.sub(r"\s+", " ", "".join(out)).strip()

    def matches(self, compound: list[tuple[str, str, str]]) -> bool:
        for kind, name, value in compound:
            has = self.attrs.get(name, "")
            if not (
                kind == "tag" and self.tag == name or kind == "class" and name in self.attrs.get("class", "").split() or kind == "id" and self.attrs.get("id") == name
                or kind == "has" and name in self.attrs or kind == "=" and has == value or kind == "*=" and value in has
            ):
                return False
        return True


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        if tag == "p" and self.at.tag == "p":
            node.parent = self.at = self.at.parent
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    tree = _Tree()
    tree.feed(markup or "")
    tree.close()
    return tree.root


_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:(\*?=)[\"']?([^\]\"']*)[\"']?)?\]|([\w-]+)")


def _compound(text: str) -> list[tuple[str, str, str]]:
    out = []
    for cls, ident, attr, op, value, tag in _PART.findall(text):
        out.append(("class", cls, "") if cls else ("id", ident, "") if ident else (op or "has", attr, value) if attr else ("tag", tag.lower(), ""))
    return out


def select_all(root: Node, selectors: tuple[str, ...]) -> dict[str, list[Node]]:
    """For each selector its elements in document order, from one walk: how far the ancestors match is handed down, so that depth costs nothing."""
    chains = [[_compound(part) for part in s.split()] for s in selectors]
    out: dict[str, list[Node]] = {s: [] for s in selectors}
    # A compound is looked at where the first of its conditions may hold.
    likely: dict[tuple[str, str], list[int]] = {}
    for k, chain in enumerate(chains):
        kind, name, _ = chain[-1][0]
        likely.setdefault((kind if kind in ("tag", "class", "id") else "has", name), []).append(k)
    long = [k for k, chain in enumerate(chains) if len(chain) > 1]
    stack = [(c, (0,) * len(long)) for c in reversed(root.children) if isinstance(c, Node)]
    # The root itself, which has no name, may be an ancestor too.
    while stack:
        node, above = stack.pop()
        keys = [("tag", node.tag), *(("class", c) for c in set(node.attrs.get("class", "").split())), ("id", node.attrs.get("id", "")), *(("has", a) for a in node.attrs)]
        for k in sorted({k for key in keys for k in likely.get(key, ())}):
            chain = chains[k]
            if (len(chain) == 1 or above[long.index(k)] >= len(chain) - 1) and node.matches(chain[-1]):
                out[selectors[k]].append(node)
        if node.children:
            below = tuple(n + (n < len(chains[k]) - 1 and node.matches(chains[k][n])) for n, k in zip(above, long, strict=True)) if long else above
            stack.extend((c, below) for c in reversed(node.children) if isinstance(c, Node))
    return out


def select(root: Node, selector: str) -> list[Node]:
    """Elements in document order that the selector matches."""
    return select_all(root, (selector,))[selector]


def first(root: Node, selectors: str) -> Node | None:
    return next((hit for s in selectors.split(",") for hit in select(root, s.strip())), None)


def meta(root: Node, *names: str) -> str | None:
    for name in names:
        for n in root.walk():
            if n.tag == "meta" and name in (n.attrs.get("property"), n.attrs.get("name"), n.attrs.get("itemprop")) and n.attrs.get("content"):
                return n.attrs["content"].strip()
    return None


def json_ld(root: Node) -> list[dict]:
    """All typed objects in JSON-LD scripts, lists and graphs flattened."""
    out, stack = [], []
    for n in select(root, "script[type=application/ld+json]"):
        try:
            stack.append(json.loads("".join(c for c in n.children if isinstance(c, str))))
        except ValueError:
            continue
    while stack:
        x = stack.pop(0)
        if isinstance(x, list):
            stack = x + stack
        elif isinstance(x, dict):
            out.append(x)
            stack = x.get("@graph", []) + stack if isinstance(x.get("@graph"), list) else stack
    return out


PAGE = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("title", "description", "author", "image", "published")],
        T.StructField("alternatives", T.ArrayType(T.StringType())),
    ]
)


def page_fields(markup: str | None, url: str | None) -> dict:
    """A page's metadata from one parse; each field by a cascade of places."""
    root, base = parse(markup or ""), url or ""
    ld = json_ld(root)
    in_ld = lambda *keys: next((str(x[k]) for x in ld for k in keys if isinstance(x.get(k), str) and x[k].strip()), None)
    title_node, h1 = first(root, "title"), first(root, "h1")
    title = meta(root, "og:title", "twitter:title") or (title_node and title_node.text()) or (h1 and h1.text()) or None
    author = meta(root, "author", "article:author") or next((a.get("name") for x in ld for a in [x.get("author")] if isinstance(a, dict) and a.get("name")), None)
    ld_image = next((i if isinstance(i, str) else i.get("url") for x in ld for i in [x.get("image")] if isinstance(i, (str, dict))), None)
    body_image = next((n.attrs["src"] for n in select(root, "article img[src]")), None)
    image = meta(root, "og:image", "twitter:image") or ld_image or body_image
    time = first(root, "time[datetime]")
    published = meta(root, "article:published_time", "datePublished") or in_ld("datePublished", "dateCreated") or (time and time.attrs["datetime"]) or None
    links = [n.attrs["href"] for n in root.walk() if n.tag == "link" and n.attrs.get("rel", "") in ("canonical", "amphtml") and n.attrs.get("href")]
    links += [n.attrs["href"] for n in select(root, "a[href]") if n.text().lower() in ("read more", "continue reading", "full article")]
    return {
        "title": title, "description": meta(root, "og:description", "description", "twitter:description"), "author": author, "image": urljoin(base, image) if image else None, "published": published,
        "alternatives": list(dict.fromkeys(urljoin(base, u) for u in links)),
    }


@F.pandas_udf(PAGE)
def page(markup: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_fields(m, u) for m, u in zip(markup, url, strict=True)], columns=PAGE.names)


MESSAGE = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("message_id", "url", "text", "published", "forwarded_from")],
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("media", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("type", T.StringType())]))),
    ]
)
MESSAGES = T.ArrayType(MESSAGE)


def channel_messages(markup: str | None, least: int = 20) -> list[dict]:
    """Messages of a channel page: id, address, text, instant, forwarding, links and media. Short ones without media are left out."""
    out = []
    for box in select(parse(markup or ""), "[data-post]"):
        body, date, forward = first(box, ".tgme_widget_message_text"), first(box, "a.tgme_widget_message_date"), first(box, ".tgme_widget_message_forwarded_from")
        stamp = first(box, "time[datetime]")
        media = [(u, "image") for n in box.walk() for u in re.findall(r"background-image:\s*url\(['\"]?([^'\")]+)", n.attrs.get("style", "")) if "user_photo" not in n.attrs.get("class", "")]
        media += [(n.attrs["src"], "video") for n in box.walk() if n.tag in ("video", "source") and n.attrs.get("src")]
        media += [(n.attrs["src"], "image") for n in box.walk() if n.tag == "img" and n.attrs.get("src") and "user" not in n.attrs.get("class", "")]
        media += [(n.attrs["href"], "document") for n in select(box, "a.tgme_widget_message_document_wrap[href]")]
        text = body.text() if body is not None else ""
        if len(text) < least and not media:
            continue
        links = [n.attrs["href"] for n in body.walk() if n.tag == "a" and n.attrs.get("href", "").startswith("http")] if body is not None else []
        out.append(
            {
                "message_id": box.attrs["data-post"].rpartition("/")[2], "url": date.attrs.get("href") if date is not None else None, "text": text, "published": stamp.attrs["datetime"] if stamp is not None else None,
                "forwarded_from": forward.text() if forward is not None else None, "links": list(dict.fromkeys(links)), "media": [{"url": u, "type": t} for u, t in dict.fromkeys(media)],
            }
        )
    return out


@F.pandas_udf(MESSAGES)
def messages(markup: pd.Series) -> pd.Series:
    return markup.map(channel_messages)


ITEMS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "link", "description", "published")]))


# Selectors of a list page's items and of their titles, in order.
ITEM_SELECTORS = "article, .article, .news-item, .post, .entry, .changelog-item, .update-item, .release-note, .content li, .main li, ul.updates li, ul.news li"
TITLE_SELECTORS = "h1, h2, h3, h4, .title, .headline, .heading, a[href], .link, .post-title, .article-title"


def list_items(markup: str | None, url: str | None, items: str = ITEM_SELECTORS, titles: str = TITLE_SELECTORS) -> list[dict]:
    """Items of a list page by the first selector with hits: title, link, text and date; one of each title."""
    root = parse(markup or "")
    found = next((hits for s in items.split(",") if (hits := select(root, s.strip()))), [])
    out: dict[str, dict] = {}
    for box in found:
        head = first(box, titles)
        title = head.text() if head is not None else ""
        link = next((n.attrs["href"] for n in ([head] if head is not None else []) + select(box, "a[href]") if n.attrs.get("href")), None)
        stamp = first(box, "time[datetime], .date")
        text = box.text()
        if title:
            out.setdefault(
                title.lower(),
                {"title": title, "link": urljoin(url or "", link) if link else url, "description": text[:500] + "..." * (len(text) > 500), "published": (stamp.attrs.get("datetime") or stamp.text()) if stamp is not None else None},
            )
    return list(out.values())


@F.pandas_udf(ITEMS)
def items(markup: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([list_items(m, u) for m, u in zip(markup, url, strict=True)])


def chat_markup(markup: str | None, most: int = 4000) -> str:
    """Only a chat client's tags, links with their address only; cut between tags, which are closed."""
    out, size, stack = [], 0, [parse(markup or "")]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):  # the end of an element
            out.append(f"</{x[0]}>")
        elif size >= most:
            continue
        elif isinstance(x, str):
            piece = entities.escape(x, quote=False)
            if size + len(piece) > most:
                piece = piece[: most - size].rpartition("&")[0] if "&" in piece[max(0, most - size - 6) : most - size] else piece[: most - size]
                size = most
            out.append(piece)
            size += len(piece)
        elif x.tag not in SILENT:
            if x.tag in CHAT_TAGS and (x.tag != "a" or x.attrs.get("href")):
                opened = f'<a href="{entities.escape(x.attrs["href"])}">' if x.tag == "a" else f"<{x.tag}>"
                out.append(opened)
                size += len(opened) + len(x.tag) + 3
                stack.append((x.tag,))
            elif x.tag == "br":
                out.append("\n")
            stack.extend(reversed(x.children))
    return "".join(out)


@F.pandas_udf(T.StringType())
def chat_html(markup: pd.Series) -> pd.Series:
    return markup.map(chat_markup)


def decoded(content: bytes | None, declared: str | None) -> str | None:
    """Bytes by their declared character set, then by a mark or UTF-8, then with replacements."""
    if content is None:
        return None
    for name in (declared, "utf-8-sig" if content[:3] == b"\xef\xbb\xbf" else None, "utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else None, "utf-8", "cp1251"):
        if name:
            try:
                return content.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
    return content.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decode_bytes(content: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([decoded(c, d) for c, d in zip(content, declared, strict=True)])

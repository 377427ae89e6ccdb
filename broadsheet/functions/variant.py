"""JSON whose shape differs from row to row, read as VARIANT: JSON-LD of pages, discussion threads, raw fields of articles. No Python, and no schema that all of them would have to share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_SCRIPT = r"(?is)<script[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
#: Authors whose comments are left out, texts of comments that are gone, how many comments are looked at and taken, how long they have to be.
BOTS = ("automoderator", "automod", "bot")
GONE = ("[deleted]", "[removed]")
LOOKED_AT, TAKEN, LONGER_THAN = 10, 5, 20
COMMENTS = "Комментарии:"


def at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def text_at(value: Column, path: str) -> Column:
    """A string; null where there is none or something else."""
    return F.when(F.schema_of_variant(at(value, path, "variant")) == "STRING", at(value, path, "string"))


def _entries(value: Column) -> Column:
    """The elements of a list, or the value itself."""
    return F.coalesce(at(value, "$", "array<variant>"), F.array(value))


def _with_graph(value: Column, deep: int = 2) -> Column:
    graph = at(value, "$['@graph']", "array<variant>")
    inner = F.flatten(F.transform(graph, _entries))
    inner = F.flatten(F.transform(inner, lambda v: _with_graph(v, deep - 1))) if deep > 1 else inner
    return F.concat(F.array(value), F.coalesce(inner, F.array().cast("array<variant>")))


def json_ld(markup: Column) -> Column:
    """Objects of a page's JSON-LD scripts in order, each followed by those of its graph (and of a graph in that); scripts that are not JSON are left out."""
    parsed = F.filter(F.transform(F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(_SCRIPT), 1), F.try_parse_json), lambda v: v.isNotNull())
    return F.flatten(F.transform(F.flatten(F.transform(parsed, _entries)), lambda v: _with_graph(v)))


def _first(objects: Column, of) -> Column:
    """The first that is there of a value of each object."""
    return F.try_element_at(F.filter(F.transform(objects, of), lambda x: x.isNotNull()), F.lit(1))


def _said(value: Column, key: str) -> Column:
    text = text_at(value, f"$.{key}")
    return F.when(strip(text) != "", text)


def published(objects: Column) -> Column:
    return _first(objects, lambda v: F.coalesce(_said(v, "datePublished"), _said(v, "dateCreated")))


def article_body(objects: Column) -> Column:
    return _first(objects, lambda v: _said(v, "articleBody"))


def author(objects: Column) -> Column:
    """Of the first author that has a name: an object, a list of them, or a text."""
    return _first(objects, lambda v: F.coalesce(_said(v, "author.name"), _said(v, "author[0].name"), _said(v, "author")))


def image(objects: Column) -> Column:
    """An address, an object with one, or the first of a list of either."""
    return _first(objects, lambda v: F.coalesce(_said(v, "image"), _said(v, "image.url"), _said(v, "image[0]"), _said(v, "image[0].url")))


def thread(document: Column) -> Column:
    """A post with its comments, from a thread's JSON (a list of two listings: the post, then its comments): a struct of title, author, published, description, image, link, content; null where there is no post.

    Of the first `LOOKED_AT` top-level comments those by people count that are longer than `LONGER_THAN` characters, at most `TAKEN`; answers to comments do not. A post of its own text is that text under its title; others are
    their title with the comments.
    """
    whole = F.try_parse_json(document)
    post = at(whole, "$[0].data.children[0].data", "variant")
    empty = lambda c: F.coalesce(c, F.lit(""))
    said = lambda key: empty(text_at(post, f"$.{key}"))
    title, own, link, hint = said("title"), strip(said("selftext")), said("url"), said("post_hint")
    is_self = F.coalesce(at(post, "$.is_self", "boolean"), F.lit(False))

    def counts(c: Column) -> Column:
        body, by = strip(empty(text_at(c, "$.data.body"))), F.lower(empty(text_at(c, "$.data.author")))
        marked = at(c, "$.data.distinguished", "string")
        return F.when((F.length(body) > LONGER_THAN) & ~body.isin(*GONE) & ~by.isin(*BOTS) & (marked.isNull() | (marked == "")), body)

    told = F.slice(F.filter(F.transform(F.slice(F.coalesce(at(whole, "$[1].data.children", "array<variant>"), F.array().cast("array<variant>")), 1, LOOKED_AT), counts), lambda b: b.isNotNull()), 1, TAKEN)
    below = F.when(F.size(told) > 0, F.concat(F.lit(f"\n\n{COMMENTS}\n"), F.array_join(told, "\n\n"))).otherwise("")
    content = F.when(is_self & (own != ""), F.concat(title, F.lit("\n\n"), own)).when((hint == "image") | (own == ""), F.concat(title, below)).otherwise(F.concat(title, F.lit("\n\n"), own, below))
    shown = F.replace(text_at(post, "$.preview.images[0].source.url"), F.lit("&amp;"), F.lit("&"))
    picture = F.coalesce(F.when(shown != "", shown), F.when((hint == "image") | F.lower(link).rlike(r"\.(jpg|jpeg|png|gif|webp)$"), link))
    seconds = at(post, "$.created_utc", "double")
    return F.when(
        post.isNotNull() & (strip(content) != ""),
        F.struct(
            title.alias("title"), said("author").alias("author"), F.when(seconds != 0, F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published"), F.when(own != "", F.substring(own, 1, 200)).alias("description"),
            picture.alias("image"), F.when(~is_self & (hint != "image") & (link != ""), link).alias("link"), content.alias("content"),
        ),
    )


def is_true(value: Column) -> Column:
    """Whether a value counts as true: not null, false, zero, or an empty text, list or object."""
    kind = F.schema_of_variant(value)
    number, size = F.try_variant_get(value, "$", "double"), F.size(at(value, "$", "array<variant>"))
    told = F.when(kind == "BOOLEAN", at(value, "$", "boolean")).when(kind == "STRING", at(value, "$", "string") != "").when(kind.startswith("ARRAY"), size > 0).when(kind.startswith("OBJECT"), kind != "OBJECT<>").when(kind == "VOID", False)
    return F.coalesce(told, number != 0, F.lit(False))


def ad_fields(raw: Column, flag: Column, confidence: Column, kind: Column, reasoning: Column, markers: Column, processed: Column) -> Column:
    """An article's advertising fields after those of its raw data (JSON): a struct of is_advertisement, ad_confidence, ad_type, ad_reasoning, ad_markers (JSON), ad_processed.

    Nothing changes where the raw data knows nothing of advertising. The flag is whatever counts as true; a confidence that counts as false is 0. A confidence that is no number ends the merge: the flag is taken, all else stays, and
    the article is not marked as processed.
    """
    data = F.try_parse_json(raw)
    has = lambda key: at(data, f"$.{key}", "variant").isNotNull()
    known = has("advertising_detection") | has("is_advertisement")
    told = at(data, "$.ad_confidence", "variant")
    number = F.when(~is_true(told), 0.0).when(F.schema_of_variant(told) == "STRING", F.trim(at(told, "$", "string")).try_cast("double")).when(F.schema_of_variant(told) == "BOOLEAN", 1.0).otherwise(at(told, "$", "double"))
    whole = known & (~has("ad_confidence") | number.isNotNull())
    text = lambda key: at(data, f"$.{key}", "string")
    taken = lambda key, value, own: F.when(whole & has(key), value).otherwise(own)
    return F.struct(
        F.when(known, is_true(at(data, "$.is_advertisement", "variant"))).otherwise(flag).alias("is_advertisement"), taken("ad_confidence", number, confidence).alias("ad_confidence"), taken("ad_type", text("ad_type"), kind).alias("ad_type"),
        taken("ad_reasoning", text("ad_reasoning"), reasoning).alias("ad_reasoning"), taken("ad_markers", F.to_json(at(data, "$.ad_markers", "variant")), markers).alias("ad_markers"), F.when(whole, True).otherwise(processed).alias("ad_processed"),
    )

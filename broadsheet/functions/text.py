"""Text column functions. Patterns are Unicode-aware where the semantics are."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Opening phrases of machine-written summaries, and words of page furniture.
SUMMARY_OPENINGS = (
    "Краткое содержание статьи на русском языке с основными тезисами:", "Краткое содержание статьи на русском языке:", "Краткое содержание:", "Основные тезисы статьи:", "Основные тезисы:",
    "Суммаризация статьи:", "Пересказ статьи:", "Содержание статьи:", "Вот краткое содержание:", "Вот основные тезисы:", "Статья содержит следующие основные моменты:", "Статья рассказывает о следующем:", "ПЕРЕСКАЗ:",
)
FURNITURE = ("Advertisement", "Sponsored", "Click here", "Read more", "Subscribe", "Follow us", "Share", "Tweet", "Continue reading")


WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def clean_summary(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    some = F.lower(out).rlike("|".join(p.lower() for p in SUMMARY_OPENINGS))  # most texts have none of them
    without = out
    for phrase in SUMMARY_OPENINGS:
        without = F.regexp_replace(without, rf"(?imuUd)^{phrase}\s*", "")
    out = F.when(some, without).otherwise(out)
    out = strip(out)
    out = F.regexp_replace(out, r"(?mUd)^[-•·*]\s*", "")
    out = F.regexp_replace(out, r"(?mUd)^\d+\.\s*$", "")
    out = F.regexp_replace(out, r"(?U)\n\s*\n", "\n\n")
    return strip(F.regexp_replace(out, r"(?U):\s*$", ""))


def clean_text(text: Column) -> Column:
    """White space collapsed, furniture words removed where they stand alone, no blanks before punctuation."""
    out = collapse(F.coalesce(text, F.lit("")))
    for phrase in FURNITURE:
        out = F.regexp_replace(out, rf"(?iuU)(?<!\w){phrase}(?!\w)\s*", "")
    return strip(F.regexp_replace(out, r"(?U)\s+([.,:;!?])", "$1"))


def truncate_at_sentence(text: Column, most: int) -> Column:
    """Up to the last sentence end if that is past half of `most`, else up to the last whole word and '...'."""
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?]) ", 1)
    parts = words(head)
    by_word = F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(text) <= most, text).when(F.length(sentence) > most // 2, sentence).otherwise(by_word)


def truncate_title(title: Column) -> Column:
    """At most 120 characters, cut at the first kind of break that leaves more than 60."""
    head = F.substring(title, 1, 120)
    out = F.when(F.length(title) <= 120, title)
    for mark in (". ", "! ", "? ", ": ", " - ", " – ", " — "):
        back = F.locate(mark[::-1], F.reverse(head))
        at = F.length(head) - back + 1 - len(mark)
        out = out.when((back > 0) & (at > 60), strip(F.substr(head, F.lit(1), at + 1)))
    parts = words(head)
    return out.otherwise(F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "), F.lit("..."))).otherwise(F.concat(F.substring(title, 1, 117), F.lit("..."))))


def message_title(text: Column, default: str = "Telegram Post") -> Column:
    """The first line with text, without forwarding marks, cut to a title's length."""
    line = F.try_element_at(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != ""), F.lit(1))
    line = F.regexp_replace(line, r"(?iuU)^(Forwarded from|Reply to|@\w+:?\s*)", "")
    return F.coalesce(truncate_title(F.regexp_replace(line, r"(?U)^\s*[\x{1F517}\x{1F4CE}\x{1F4F7}\x{1F3A5}\x{1F4C4}]\s*", "")), F.lit(default))


def hashtags(text: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(?:(?<=\s)|^)#(\w+)"), 1), F.lower)), 1, most)


def clean_message(text: Column) -> Column:
    out = collapse(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    out = F.regexp_replace(out, r"(?U)^[↩↪➡⬅→←]\s*.+$\n?", "")
    return strip(F.regexp_replace(out, r"(?iuU)^Forwarded from\s*.+$\n?", ""))


def without_tags(markup: Column) -> Column:
    """Text of markup without scripts, styles, comments and tags; white space collapsed."""
    out = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    return strip(collapse(F.regexp_replace(out, r"<[^>]+>", " ")))


def first_words(text: Column, n: int) -> Column:
    parts = words(text)
    return F.when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit("..."))).otherwise(F.array_join(parts, " "))


def escape_html(text: Column) -> Column:
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def learned_method(name: Column) -> Column:
    """One learned_pattern_ prefix, whatever came before; nothing left is 'unknown'."""
    bare = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^(learned_pattern_)+", "")
    return F.concat(F.lit("learned_pattern_"), F.when(bare == "", F.lit("unknown")).otherwise(bare))


def json_of_reply(text: Column) -> Column:
    """The JSON object in a model's reply: what a code fence holds, from the first { to the last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    body = strip(F.when(fenced != "", fenced).otherwise(F.coalesce(text, F.lit("{}"))))
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(body.startswith("{") | (inner == ""), body).otherwise(inner)


def markdown_to_html(text: Column) -> Column:
    """Headings of the first two levels and bold runs as <b>, other text escaped, line by line."""

    def line(x: Column) -> Column:
        bold = F.regexp_replace(escape_html(x), r"\*\*(.*?)\*\*", "<b>$1</b>")
        for mark in ("# ", "## "):
            bold = F.when(x.startswith(mark), F.concat(F.lit("<b>"), strip(F.substr(x, F.lit(len(mark) + 1))), F.lit("</b>"))).otherwise(bold)
        return bold

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def extractive_summary(text: Column) -> Column:
    """The first sentences of 15 characters or more: four, or as many as pass 600 characters; cut at 700."""
    sentences = F.filter(F.split(strip(text), r"(?<=[.!?])(?U:\s+)"), lambda s: F.length(s) >= 15)
    start = F.struct(F.array().cast("array<string>").alias("picked"), F.lit(0).alias("total"))
    full = F.aggregate(
        F.slice(sentences, 1, 4), start,
        lambda acc, s: F.when(acc["total"] > 600, acc).otherwise(F.struct(F.concat(acc["picked"], F.array(s)).alias("picked"), (acc["total"] + F.length(s)).alias("total"))),
    )
    joined = F.array_join(full["picked"], " ")
    return F.when(F.length(joined) > 700, F.concat(F.substring(joined, 1, 700), F.lit("..."))).otherwise(joined)


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_entities(text: Column) -> Column:
    """Entities resolved, then whatever is left of broken links, tags and angle brackets removed."""
    out = unescape_html(text)
    out = F.regexp_replace(out, "[\"']>", " ")
    out = F.regexp_replace(out, r"(?U)<?\s*a\s+href=['\"]?[^\s'\"<>]*['\"]?\s*[^<>]*/?a\s*>?", " ")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = F.regexp_replace(out, r"(?U)@\w+\s+/[^\s]*\s+Читать оригинал", "")
    return strip(collapse(F.translate(out, "<>", "  ")))


@F.pandas_udf(T.StringType())
def clean_url(url: pd.Series) -> pd.Series:
    """Compatibility forms normalised; control, format and unassigned characters removed."""

    def one(u: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKC", u) if unicodedata.category(c)[0] != "C").strip()

    return url.map(one, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def is_summary_of(summary: pd.Series, original: pd.Series) -> pd.Series:
    """60 characters or more, with Cyrillic, and less than 0.8 like the original."""
    import difflib

    def one(s, o) -> bool:
        if not s or len(s) < 60 or not any("а" <= c.lower() <= "я" for c in s):
            return False
        return difflib.SequenceMatcher(None, s[:1000], (o or "")[:1000]).ratio() <= 0.8

    return pd.Series([one(s, o) for s, o in zip(summary, original, strict=True)], dtype=bool)

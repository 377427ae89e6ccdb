"""Scores, gates and classifications of articles, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip, words
from .urls import SKIP_DOMAINS, contains_any

# Patterns and word lists.
SPAM = (
    r"\b(?:click here|кликни здесь|жми сюда)\b", r"\b(?:buy now|купи сейчас|заказать сейчас)\b", r"\$\$\$+", r"!!!{3,}", r"\b(?:free|бесплатно)\s+(?:download|скачать)\b",
    r"\b(?:limited time|ограниченное время)\b", r"\b(?:act now|действуй сейчас)\b",
)
NAVIGATION = (
    r"^\s*(?:home|главная|news|новости|about|о нас|contact|контакты)\s*$", r"^\s*(?:menu|меню|navigation|навигация)\s*", r"^\s*(?:cookie|куки)\s+(?:policy|политика)",
    r"^\s*(?:privacy|конфиденциальность)\s+(?:policy|политика)", r"^\s*(?:terms|условия)\s+(?:of service|использования)", r"^\s*(?:404|error|ошибка)\s*",
)
METADATA = (
    r"\d+\s+min\s+read", r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{2}", r"^\s*\w{3}\s+\d{2}\s+.*\d+\s+min\s+read\s*$", r"\bsubscribe\s+(now|here|today)\b|\bподписаться\b",
    r"\bshare\s+(this|on|now)\b|\bpoделиться\b",
)
PERSONAL = (
    r"я\s+программист", r"мой\s+опыт", r"моя\s+компания", r"предлагаю\s+услуги", r"обращайтесь\s+по\s+телефону", r"консультаци[ия]\s+по\s+телефону", r"специализируюсь", r"оказываю\s+услуги", r"свяжитесь\s+со\s+мной",
)
NAV_WORDS = (
    "menu", "navigation", "footer", "sidebar", "advertisement", "cookie", "subscribe", "newsletter", "copyright", "all rights reserved", "terms of service", "privacy policy", "follow us", "social media",
)
ERROR_TEXT = (
    "404 not found", "page not found", "access denied", "error 404", "error 500", "internal server error", "page not available", "content not found", "please enable javascript", "javascript is required",
)
BOT_WALL = (
    "включить javascript и файлы cookie", "проверки безопасности", "является ли пользователь ботом", "just a moment", "checking if the site connection is secure", "enable javascript and cookies", "attention required",
    "checking your browser before accessing", "before you continue to google", "согласие на использование файлов cookie", "consent to the use of cookies", "we use cookies and data to",
    "uses cookies to deliver its services", "cookies help us deliver our services", "javascript is not available", "javascript не доступен", "требуется включить javascript",
)
FURNITURE_WORDS = ("click here", "read more", "subscribe", "follow us", "menu", "navigation", "sidebar", "footer", "header")
CONTENT_KINDS = {
    "changelog": (r"\b(version|v\d+|\d+\.\d+)", r"\b(released?|updated?|fixed?|added?|improved?)", r"\b(feature|bug|improvement|enhancement)"),
    "news": (r"\b(breaking|urgent|announced?|launched?)", r"\b(today|yesterday|this week|latest)", r"\b(update|news|press|release)"),
    "blog": (r"\b(posted|published|written|authored)", r"\b(tutorial|guide|how.?to|tips)", r"\b(learn|understand|master)"),
}
SUGGESTIONS = (
    ("Tech", ("tech", "software", "innovation", "digital", "ai", "computer", "programming")),
    ("Business", ("business", "economy", "finance", "market", "trade", "investment", "company")),
    ("Politics", ("politics", "government", "election", "policy", "law", "legal", "parliament")),
    ("International", ("international", "world", "global", "foreign", "europe", "russia", "china")),
    ("Serbia", ("serbia", "belgrade", "serbian", "вучич", "белград", "сербия")),
    ("Science", ("science", "research", "study", "health", "medicine", "environment", "education")),
)
#: Keywords of a category that is chosen among several; each counts as many points as it has words.
KEYWORDS = {
    "Serbia": (
        "serbia", "serbian", "belgrade", "beograd", "srbija", "srbije", "srbiju", "сербия", "сербии", "сербию", "сербский", "сербского", "сербской", "сербским", "белград", "београд", "београду", "београда",
        "vučić", "vucic", "вучич", "вучића", "president", "government", "parliament", "ministry", "президент", "правительство", "парламент", "министерство", "novi sad", "niš", "kragujevac", "subotica", "zemun",
        "vojvodina", "нови сад", "ниш", "крагуевац", "суботица", "земун", "воеводина", "kosovo", "metohija", "косово", "метохия", "метохију", "косова", "republika srpska", "bosnia", "республика srpska", "босния",
        "посольство", "посольство рф", "суверенитет", "территориальная целостность", "бомбардировка", "бомбардировке", "нато", "западные страны", "сербский народ",
    ),
    "Tech": (
        "technology", "tech", "software", "hardware", "computer", "digital", "internet", "web", "app", "application", "programming", "code", "artificial intelligence", "ai", "machine learning", "blockchain",
        "cryptocurrency", "bitcoin", "startup", "innovation", "gadget", "smartphone", "tablet", "laptop", "cloud", "data", "algorithm",
    ),
    "Business": (
        "business", "company", "corporation", "enterprise", "market", "economy", "financial", "finance", "investment", "profit", "revenue", "sales", "trade", "commerce", "industry", "manufacturing", "retail",
        "banking", "stock", "shares", "merger", "acquisition", "ceo", "management", "strategy", "growth", "expansion",
    ),
    "Science": (
        "science", "research", "study", "experiment", "discovery", "scientist", "university", "academic", "journal", "publication", "theory", "medicine", "medical", "health", "biology", "chemistry", "physics",
        "mathematics", "engineering", "laboratory", "clinical", "trial",
    ),
}
#: Which category counts where no keyword is found.
PRIORITY = ("Serbia", "Science", "Tech", "Business", "Other")
#: Characters of the content that are looked at for keywords.
KEYWORD_CHARS = 500
#: Keywords of the fallback category by weight: 3, 2 and 1 points. A keyword that a tier or two tiers name twice counts twice.
WEIGHTED = {
    "AI": (
        ("gpt", "chatgpt", "openai", "gemini", "claude", "llm", "large language model", "generative ai"),
        ("artificial intelligence", "machine learning", "neural network", "deep learning", "transformer", "ai model", "llms"), ("ai", "a.i.", "automated", "intelligent", "machine learning"),
    ),
    "Tech": (
        ("blockchain", "cryptocurrency", "cybersecurity", "cloud computing", "software development"), ("software", "algorithm", "programming", "coding", "developer", "api", "cloud", "startup", "app"),
        ("tech", "technology", "digital", "computer", "internet", "data", "online", "platform"),
    ),
    "Business": (
        ("stock market", "ipo", "merger", "acquisition", "bankruptcy", "ceo", "startup funding"), ("economy", "economic", "financial", "investment", "revenue", "profit", "startup", "trading"),
        ("business", "company", "money", "market", "trade", "finance", "economic"),
    ),
    "Science": (
        ("quantum", "genomics", "nanotechnology", "astrophysics", "biochemistry", "breakthrough"), ("research", "study", "scientist", "discovery", "experiment", "hypothesis", "published", "journal"),
        ("science", "scientific", "physics", "chemistry", "biology", "research", "study"),
    ),
    "Nature": (
        ("biodiversity", "ecosystem", "climate change", "conservation", "endangered species", "species"), ("environment", "wildlife", "ecology", "animal", "forest", "ocean", "carbon", "emissions"),
        ("nature", "natural", "earth", "planet", "green", "climate", "environmental"),
    ),
    "Serbia": (
        ("belgrade", "novi sad", "niš", "kragujevac", "vojvodina", "srbija"), ("serbian", "beograd", "republic of serbia", "serbia's", "serbs", "serbian"), ("serbia", "serb", "belgrade"),
    ),
    "Marketing": (
        ("advertising campaign", "brand strategy", "social media marketing", "influencer", "digital marketing"), ("marketing", "advertising", "brand", "promotion", "seo", "campaign", "social media"),
        ("ad", "commercial", "branding", "promotion"),
    ),
}


#: Strings of which a text must have one for a pattern to match: looking for them is much faster than the pattern.
ANCHORS = {
    SPAM[0]: ("click here", "кликни здесь", "жми сюда"), SPAM[1]: ("buy now", "купи сейчас", "заказать сейчас"), SPAM[2]: ("$$$",), SPAM[3]: ("!!!!!",), SPAM[4]: ("free", "бесплатно"),
    SPAM[5]: ("limited time", "ограниченное время"), SPAM[6]: ("act now", "действуй сейчас"), METADATA[0]: ("read",), METADATA[2]: ("read",), METADATA[3]: ("subscribe", "подписаться"), METADATA[4]: ("share", "poделиться"),
}


def any_pattern(text: Column, patterns: tuple[str, ...]) -> Column:
    """Patterns are in lower case, and so are the texts."""
    found = F.lit(False)
    for pattern in patterns:
        hit = text.rlike("(?U)" + pattern)
        found |= (contains_any(text, ANCHORS[pattern]) & hit) if pattern in ANCHORS else hit
    return found


def _text(title: Column, content: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("None")), F.lit(" "), F.coalesce(content, F.lit("None"))))


def is_navigation(title: Column, content: Column) -> Column:
    """The patterns are anchored to the text's start, the first to its end as well."""
    text = strip(_text(title, content))
    return (F.length(text) < 20) & text.rlike("(?U)" + NAVIGATION[0]) | text.rlike("(?U)" + "|".join(f"(?:{p})" for p in NAVIGATION[1:]))


def is_spam(title: Column, content: Column) -> Column:
    return any_pattern(_text(title, content), SPAM)


def is_target_language(content: Column) -> Column:
    """Few letters, or mostly Latin, or at least three tenths Cyrillic."""
    cyrillic, latin = F.regexp_count(content, F.lit("[а-яёА-ЯЁ]")), F.regexp_count(content, F.lit("[a-zA-Z]"))
    both = cyrillic + latin
    share = cyrillic.cast("double") / F.when(both > 0, both)
    return (both < 50) | (share >= 0.3) | (share <= 0.1)


def is_metadata(content: Column) -> Column:
    low, parts = strip(F.lower(content)), words(content)
    dated = low.rlike(r"\s\d{2}") & low.rlike("(?U)" + METADATA[1])
    repetitive = (F.length(strip(content)) < 100) & (F.size(parts) > 5) & (F.size(F.array_distinct(F.transform(parts, F.lower))) < 0.6 * F.size(parts))
    return any_pattern(low, (METADATA[0], *METADATA[2:])) | dated | repetitive


def quality_score(title: Column, content: Column, source_type: Column) -> Column:
    """0 to 1. The paragraph mark is the four characters \\n\\n as they are written."""
    sentences, n = F.regexp_count(content, F.lit(r"[.!?]+")), F.size(words(content))
    paragraphs = F.size(F.filter(F.split(content, r"\\n\\n"), lambda p: strip(p) != ""))
    text = _text(title, content)
    cyrillic = text.rlike("[а-яё]")
    score = (
        F.lit(0.5) + F.when(F.length(strip(title)) > 20, 0.1).otherwise(0.0)
        + F.when(sentences.between(3, 50), 0.15).when(sentences > 50, 0.05).otherwise(0.0)
        + F.when(paragraphs >= 2, 0.1).otherwise(0.0) + F.when(n.between(50, 2000), 0.1).when(n > 2000, 0.05).otherwise(0.0)
        + F.when(source_type == "rss", 0.05).when(source_type == "telegram", 0.02).when(source_type == "extraction", 0.1).otherwise(0.0)
        - F.when(content.rlike("[A-Z]{10,}"), 0.1).otherwise(0.0) - F.when(F.regexp_count(content, F.lit("!{2,}")) > 3, 0.1).otherwise(0.0)
    )
    for pattern in PERSONAL:
        score -= F.when(cyrillic & text.rlike("(?U)" + pattern), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def needs_extraction(title: Column, content: Column, url: Column) -> Column:
    """Short content of an extractable page, shorter than its title leads to expect."""
    extractable = url.rlike("^https?://") & ~contains_any(F.lower(url), SKIP_DOMAINS)
    chars, n = F.length(strip(content)), F.size(words(content))
    return extractable & (chars < 300) & (n < 50) & (((F.size(words(title)) >= 5) & (chars < 200)) | (chars < 150))


def with_filter_reason(df: DataFrame, title: str, content: str, url: str, source_type: str, duplicate: Column | None = None, allow_extraction: bool = True, out: str = "reason") -> DataFrame:
    """Rows with why an article is not processed, by the first gate that it fails; 'passed' otherwise.

    The gates are columns of a first projection: one expression of all of them would be too large for the JVM to compile.
    """
    t, c, u = (F.coalesce(F.col(x), F.lit("")) for x in (title, content, url))
    gates = df.withColumns(
        {
            "__chars": F.length(strip(c)), "__long": F.length(c) > 50_000, "__title": F.length(strip(t)) < 10, "__navigation": is_navigation(t, c), "__language": ~is_target_language(c), "__spam": is_spam(t, c),
            "__metadata": is_metadata(c), "__extractable": F.lit(allow_extraction) & u.rlike("^https?://") & ~contains_any(F.lower(u), SKIP_DOMAINS), "__needs": needs_extraction(t, c, u),
            "__score": quality_score(t, c, F.col(source_type)), "__copy": duplicate if duplicate is not None else F.lit(False),
        }
    )
    reason = (
        F.when(~F.col("__chars").between(50, 50_000), "too short").when(F.col("__long"), "too long").when(F.col("__title"), "title too short").when(F.col("__navigation"), "navigation")
        .when(F.col("__language"), "language").when(F.col("__spam"), "spam").when(F.col("__metadata") & ~F.col("__extractable"), "metadata").when(F.col("__copy"), "duplicate")
        .when(F.col("__extractable") & F.col("__needs"), "needs extraction").when(F.col("__metadata") & F.col("__extractable"), "metadata, needs extraction")
        .when(F.col("__score") < F.when(F.col(source_type) == "extraction", 0.35).otherwise(0.4), "low quality").otherwise("passed")
    )
    return gates.withColumn(out, reason).select(*[x for x in df.columns if x != out], out)


def has_frequent(items: Column, most: Column) -> Column:
    """Whether an item of the array occurs more than `most` (a whole number) times: in order, it is equal to the one `most` places on."""
    ordered = F.array_sort(items)
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(items) - most, F.lit(0))), F.slice(ordered, most + 1, F.greatest(F.size(items) - most, F.lit(0))), lambda a, b: a == b)
    return F.array_contains(pairs, True)


def is_good_content(content: Column, full_article: bool = False, least: int = 200) -> Column:
    """Length, density, sentences, variety, furniture, repetition and error pages."""
    least = max(100, least // 2) if full_article else least
    low, parts = F.lower(strip(content)), words(content)
    n, chars = F.size(parts), F.length(content)
    lowered = F.transform(parts, F.lower)
    sentences = F.filter(F.transform(F.split(content, r"\."), strip), lambda s: F.length(s) > 10)
    mean = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.length(s)).cast("double") / F.greatest(F.size(sentences), F.lit(1))
    density = n.cast("double") / F.greatest(chars, F.lit(1))
    variety = F.size(F.array_distinct(F.filter(lowered, lambda w: F.length(w) > 3))).cast("double") / F.greatest(n, F.lit(1))
    furniture = F.when(contains_any(low, NAV_WORDS), F.size(F.filter(lowered, lambda w: contains_any(w, NAV_WORDS)))).otherwise(0)
    frequent = has_frequent(F.filter(lowered, lambda w: F.length(w) > 4), F.floor(n * 0.15).cast("int"))
    good = (
        (F.length(strip(content)) >= least) & density.between(0.05, 0.5) & (F.size(sentences) >= (1 if full_article else 2)) & (mean >= 15) & (n >= 10) & (variety >= 0.3)
        & (furniture <= n * (0.15 if full_article else 0.1)) & ~frequent & ~contains_any(low, ERROR_TEXT)
    )
    return F.coalesce(good, F.lit(False))


def assess_content(text: Column) -> Column:
    """0 to 1 from length, sentences, punctuation, variety and furniture."""
    chars = F.length(text)
    sentences = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.length(strip(s)) > 10))
    marks = F.regexp_count(text, F.lit("[.!?,:;]")).cast("double") / F.greatest(chars, F.lit(1))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)
    variety = F.size(F.array_distinct(tokens)).cast("double") / F.greatest(F.size(tokens), F.lit(1))
    low = F.lower(text)
    furniture = sum((F.contains(low, F.lit(w)).cast("int") for w in FURNITURE_WORDS), F.lit(0))
    score = (
        F.when(chars.between(200, 3000), 0.3).when(chars.between(100, 5000), 0.2).otherwise(0.1) + F.when(sentences >= 3, 0.2).when(sentences >= 1, 0.1).otherwise(0.0)
        + F.when(marks.between(0.02, 0.15), 0.2).when(marks.between(0.01, 0.25), 0.1).otherwise(0.0) + F.when(F.size(tokens) == 0, 0.0).when(variety >= 0.4, 0.2).when(variety >= 0.2, 0.1).otherwise(0.0)
        + F.when(furniture == 0, 0.1).when(furniture <= 2, 0.05).otherwise(0.0)
    )
    return F.when(text.isNull() | (chars < 50), 0.0).otherwise(F.least(F.lit(1.0), score))


def is_bot_wall(content: Column) -> Column:
    return (F.length(strip(content)) < 500) & contains_any(F.lower(content), BOT_WALL)


def content_kind(title: Column, content: Column) -> Column:
    """The first kind of which at least two patterns match, else 'general'."""
    text = _text(title, content)
    out = F.when(F.lit(False), "")
    for kind, patterns in CONTENT_KINDS.items():
        out = out.when(sum((text.rlike("(?U)" + p).cast("int") for p in patterns), F.lit(0)) >= 2, kind)
    return out.otherwise("general")


def suggested_category(label: Column) -> Column:
    """By the first family of keywords of which the label has one as a substring."""
    low = F.lower(label)
    out = F.when(label.isNull() | (label == ""), "Other")
    for category, keywords in SUGGESTIONS:
        out = out.when(contains_any(low, keywords), category)
    return out.otherwise("Other")


def parsed_categories(raw: Column, valid: tuple[str, ...]) -> Column:
    """Valid categories in a composite label, split at the first kind of separator that it has; ['Other'] if none.

    'OR' anywhere, even inside a word, is a separator.
    """
    label = F.trim(F.replace(F.replace(F.trim(raw), F.lit("(choose ONE category only)"), F.lit("")), F.lit("OR"), F.lit("|")))
    letters = lambda x: F.regexp_replace(x, r"[^\p{L}]", "")
    found = F.array(letters(label))
    for mark in reversed(("|", "/", ",", " and ", " & ")):
        parts = F.transform(F.split(label, r"\|" if mark == "|" else mark), letters)
        found = F.when(F.contains(label, F.lit(mark)), parts).otherwise(found)
    kept = F.filter(found, lambda x: x.isin(*valid))
    whole = letters(label)
    return F.when(F.size(kept) > 0, kept).when(whole.isin(*valid), F.array(whole)).otherwise(F.array(F.lit("Other")))


def keyword_score(text: Column, keywords: tuple[str, ...]) -> Column:
    """Words of the keywords that the text has as substrings."""
    return reduce(lambda a, k: a + F.when(F.contains(text, F.lit(k)), len(k.split())).otherwise(0), dict.fromkeys(keywords), F.lit(0))


def keyword_text(title: Column, content: Column) -> Column:
    """What keywords are looked for in: the title and the first `KEYWORD_CHARS` characters of the content."""
    part = lambda x, end="": F.coalesce(F.when(x != "", F.concat(F.lower(x), F.lit(end))), F.lit(""))
    return F.concat(part(title, " "), part(F.substring(content, 1, KEYWORD_CHARS)))


def _candidate_scores(text: Column, candidates: Column) -> Column:
    """(category, place, score) of each candidate."""
    points = F.create_map(*[x for c, words in KEYWORDS.items() for x in (F.lit(c), keyword_score(text, words))])
    return F.transform(candidates, lambda c, i: F.struct(c.alias("category"), i.alias("place"), F.coalesce(F.try_element_at(points, c), F.lit(0)).alias("score")))


def best_category(text: Column, candidates: Column) -> Column:
    """Of several categories that with the most points of its keywords, the first of equals; without any, the first in `PRIORITY`, else the first. `text`: see `keyword_text`."""
    scored = _candidate_scores(text, candidates)
    best = F.array_max(F.transform(scored, lambda x: F.struct(x["score"].alias("score"), (-x["place"]).alias("back"), x["category"].alias("category"))))
    preferred = F.try_element_at(F.filter(F.array(*map(F.lit, PRIORITY)), lambda p: F.array_contains(candidates, p)), F.lit(1))
    return F.when(F.size(candidates) <= 1, F.try_element_at(candidates, F.lit(1))).when(best["score"] > 0, best["category"]).otherwise(F.coalesce(preferred, F.try_element_at(candidates, F.lit(1))))


def category_confidences(text: Column, candidates: Column) -> Column:
    """(name, confidence) of the candidates, most confident first: 0.6 and more by their share of all points, 0.3 without points; 0.7 less a tenth for each place where no candidate has points. Below 0.3 only if all are."""
    scored = _candidate_scores(text, candidates)
    total = F.aggregate(scored, F.lit(0), lambda a, x: a + x["score"])
    share = lambda x: F.when(total == 0, F.lit(0.7) - 0.1 * x["place"]).when(x["score"] > 0, F.lit(0.6) + x["score"].cast("double") / total * 0.4).otherwise(0.3)
    found = F.transform(scored, lambda x: F.struct((-F.round(share(x), 2)).alias("minus"), x["place"].alias("place"), x["category"].alias("name")))
    kept = F.filter(found, lambda x: x["minus"] <= -0.3)
    ordered = F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(found))
    many = F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("confidence")))
    return F.when(F.size(candidates) == 1, F.array(F.struct(candidates[0].alias("name"), F.lit(1.0).alias("confidence")))).otherwise(many)


def fallback_category(title: Column, content: Column) -> Column:
    """The first category with the most points of its keywords in the whole title and content, if that has two at least; else 'Other'."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))
    points = lambda tiers: sum((F.when(F.contains(text, F.lit(k)), 3 - i).otherwise(0) for i, tier in enumerate(tiers) for k in tier), F.lit(0))
    best = F.array_max(F.array(*[F.struct(points(tiers).alias("score"), F.lit(-place).alias("place"), F.lit(c).alias("category")) for place, (c, tiers) in enumerate(WEIGHTED.items())]))
    return F.when(best["score"] >= 2, best["category"]).otherwise("Other")

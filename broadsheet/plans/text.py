"""Queries: text, URL, date, media and scoring functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.domain import AS_OF, Domain
from broadsheet.functions import dates as D
from broadsheet.functions import extraction as E
from broadsheet.functions import media as M
from broadsheet.functions import scoring as S
from broadsheet.functions import text as X
from broadsheet.functions import urls as U
from broadsheet.operators.dedup import mark_copies

from .registry import plan

_TS = f"timestamp '{AS_OF}'"
_AUTH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _pages(d: Domain):
    return d.table("pages").select("page_id", "url")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(x: str, marks) -> str:
    return "(" + " OR ".join(f"contains({x}, {_quoted(m)})" for m in marks) + ")"


def _re(patterns) -> str:
    """The patterns for DuckDB: words in either script, no Unicode word boundary needed on this data."""
    return _quoted("|".join(f"(?:{p})" for p in patterns))


plan("o160_url_domain", f"SELECT page_id, {_AUTH} AS domain FROM pages")(lambda d: _pages(d).select("page_id", U.domain_of(F.col("url")).alias("domain")))
plan(
    "o066_valid_urls",
    f"SELECT page_id, regexp_matches(url, '^https?://') AND contains({_AUTH}, '.') AND NOT regexp_matches(lower({_PATH}), '\\.({'|'.join(U.FILE_ENDINGS)})$') AS valid FROM pages",
)(lambda d: _pages(d).select("page_id", U.is_valid_article_url(F.col("url")).alias("valid")))
plan("o067_skipped_urls", f"SELECT page_id, {_any('lower(url)', U.SKIP_DOMAINS)} AS skipped FROM pages")(lambda d: _pages(d).select("page_id", U.is_skipped(F.col("url")).alias("skipped")))
plan(
    "o068_maps_and_stores",
    f"SELECT page_id, {_any(_AUTH, U.MAP_AND_STORE_HOSTS)} OR (contains({_AUTH}, 'google.com') OR contains({_AUTH}, 'yandex')) AND contains(lower({_PATH}), '/maps') AS skipped FROM pages",
)(lambda d: _pages(d).select("page_id", U.is_map_or_store(F.col("url")).alias("skipped")))
_TRACKED = "concat(regexp_extract(url, '^([^#]*)', 1), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_source=a&k=1&fbclid=', page_id, '#end')"
_KEPT = f"list_filter(string_split(regexp_extract(t, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains([{', '.join(map(_quoted, U.TRACKING))}], string_split(p, '=')[1]))"
plan("o165_without_tracking", f"SELECT page_id, concat(regexp_extract(t, '^([^?#]*)', 1), CASE WHEN len({_KEPT}) > 0 THEN concat('?', array_to_string({_KEPT}, '&')) ELSE '' END) AS url FROM (SELECT page_id, {_TRACKED} AS t FROM pages)")(
    lambda d: _pages(d).select(
        "page_id",
        U.without_tracking(
            F.concat(F.regexp_extract("url", "^([^#]*)", 1), F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_source=a&k=1&fbclid="), F.col("page_id").cast("string"), F.lit("#end"))
        ).alias("url"),
    )
)
plan("o175_image_urls", f"SELECT page_id, regexp_matches(lower(url), '^https?://') AND (regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|webp|bmp|svg)$') OR {_any('lower(url)', U.IMAGE_HOST_MARKS)}) AS is_image FROM pages")(
    lambda d: _pages(d).select("page_id", U.is_image_url(F.col("url")).alias("is_image"))
)
_CH = "regexp_extract(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '(?:t|telegram)\\.me/(?:s/)?([^/?#]+)', 1)"
plan("o176_channel_names", f"SELECT page_id, CASE WHEN {_CH} <> '' THEN {_CH} ELSE regexp_extract(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '^([^/?#]*)', 1) END AS channel FROM pages")(
    lambda d: _pages(d).select("page_id", U.channel_name(F.col("url")).alias("channel"))
)
_IMG = "concat(url, '/cdn', page_id, '.t.me/file/', page_id, '.jpg')"
plan("o183_channel_images", f"SELECT page_id, concat('https://t.me/file/', regexp_extract({_IMG}, 'cdn\\d*\\.t\\.me/file/(.*)', 1)) AS image, NOT {_any(f'lower({_IMG})', ('/img/emoji/', '/userpic/', '/channel_photo/', '/profile_photo/', '16x16', '32x32', '50x50', '64x64', 'thumb', 'icon', 'avatar'))} AS is_content FROM pages")(
    lambda d: _pages(d).withColumn("u", F.concat("url", F.lit("/cdn"), F.col("page_id").cast("string"), F.lit(".t.me/file/"), F.col("page_id").cast("string"), F.lit(".jpg"))).select("page_id", U.channel_image(F.col("u")).alias("image"), U.is_content_image(F.col("u")).alias("is_content"))
)
plan("o244_hashes", "SELECT id, sha256(concat(title, ':', url)) AS content_hash, md5(concat(title, url)) AS page_hash FROM articles")(
    lambda d: d.articles.select("id", F.sha2(F.concat_ws(":", "title", "url"), 256).alias("content_hash"), F.md5(F.concat("title", "url")).alias("page_hash"))
)
plan("o145_both_hashes", "SELECT id, md5(lower(" + _strip("content") + ")) AS text_hash, sha256(concat(title, ':', url)) AS address_hash FROM articles")(
    lambda d: d.articles.select("id", F.md5(F.lower(X.strip(F.col("content")))).alias("text_hash"), F.sha2(F.concat_ws(":", "title", "url"), 256).alias("address_hash"))
)

_SUMMARY = "coalesce(text, '')"
for _p in X.SUMMARY_OPENINGS:
    _SUMMARY = f"regexp_replace({_SUMMARY}, '(?im)^{_p}\\s*', '', 'g')"
_SUMMARY = f"regexp_replace(regexp_replace(regexp_replace({_strip(_SUMMARY)}, '(?m)^[-•·*]\\s*', '', 'g'), '(?m)^\\d+\\.\\s*$', '', 'g'), '\\n\\s*\\n', chr(10) || chr(10), 'g')"
plan("o162_clean_summary", f"SELECT doc_id, md5({_strip(f'regexp_replace({_SUMMARY}, chr(58) || chr(92) || chr(115) || chr(42) || chr(36), chr(0)[2:2])')}) AS h FROM documents".replace("chr(58) || chr(92) || chr(115) || chr(42) || chr(36), chr(0)[2:2]", "':\\s*$', ''"))(
    lambda d: d.spread("documents").select("doc_id", F.md5(X.clean_summary(F.col("text"))).alias("h"))
)
_CLEAN = "regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')"
for _p in X.FURNITURE:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?i)\\b{_p}\\b\\s*', '', 'g')"
plan("o163_clean_text", f"SELECT doc_id, md5({_strip(f'regexp_replace({_CLEAN}, {_quoted(chr(92) + "s+([.,:;!?])")}, {_quoted(chr(92) + "1")}, {_quoted("g")})')}) AS h FROM documents")(
    lambda d: d.spread("documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("h"))
)


def _truncate(t: str, n: int) -> str:
    head, sentence = f"substring({t}, 1, {n})", f"regexp_extract(substring({t}, 1, {n}), '(?s)^(.*[.!?]) ', 1)"
    parts = _words(head)
    return f"""CASE WHEN length({t}) <= {n} THEN {t} WHEN length({sentence}) > {n // 2} THEN {sentence} WHEN len({parts}) > 1 THEN concat(array_to_string({parts}[1:len({parts}) - 1], ' '), '...') ELSE concat({head}, '...') END"""


plan("o166_truncated", f"SELECT doc_id, {_truncate('text', 300)} AS t FROM documents")(lambda d: d.table("documents").select("doc_id", X.truncate_at_sentence(F.col("text"), 300).alias("t")))
plan("o215_fallback_summary", f"SELECT id, CASE WHEN length({_strip('content')}) > length(title) * 1.5 THEN {_truncate('content', 500)} ELSE title END AS summary FROM articles")(
    lambda d: d.articles.select("id", F.when(F.length(X.strip(F.col("content"))) > F.length("title") * 1.5, X.truncate_at_sentence(F.col("content"), 500)).otherwise(F.col("title")).alias("summary"))
)


def _title(t: str) -> str:
    head = f"substring({t}, 1, 120)"
    out = f"CASE WHEN length({t}) <= 120 THEN {t}"
    for m in (". ", "! ", "? ", ": ", " - ", " – ", " — "):
        back = f"strpos(reverse({head}), {_quoted(m[::-1])})"
        at = f"(length({head}) - {back} + 1 - {len(m)})"
        out += f" WHEN {back} > 0 AND {at} > 60 THEN {_strip(f'substring({head}, 1, {at} + 1)')}"
    parts = _words(head)
    return out + f" WHEN len({parts}) > 1 THEN concat(array_to_string({parts}[1:len({parts}) - 1], ' '), '...') ELSE concat(substring({t}, 1, 117), '...') END"


plan("o167_short_titles", f"SELECT doc_id, {_title('t')} AS title FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)")(
    lambda d: d.table("documents").select("doc_id", X.truncate_title(F.replace("text", F.lit("\n"), F.lit(" "))).alias("title"))
)
_LINE = "regexp_replace(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: " + _strip("x") + "), lambda x: x <> '')[1], '(?i)^(Forwarded from|Reply to|@[\\p{L}\\p{N}_]+:?\\s*)', '')"
plan("o168_message_titles", f"SELECT conv_id, turn, coalesce({_title('t')}, 'Telegram Post') AS title FROM (SELECT conv_id, turn, {_LINE} AS t FROM conversations)")(
    lambda d: d.table("conversations").select("conv_id", "turn", X.message_title(F.col("text")).alias("title"))
)
_TAGGED = "replace(replace(coalesce(text, ''), ' the ', ' #The '), '***', ' #star')"
plan("o169_hashtags", f"SELECT doc_id, array_to_string(list_distinct_first[1:20], ',') AS tags FROM (SELECT doc_id, list_filter(tags, lambda t, i: list_position(tags, t) = i) AS list_distinct_first FROM (SELECT doc_id, list_transform(regexp_extract_all({_TAGGED}, '(?:^|\\s)#([\\p{{L}}\\p{{N}}_]+)', 1), lambda t: lower(t)) AS tags FROM documents))")(
    lambda d: d.table("documents").select("doc_id", F.array_join(X.hashtags(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(" #The ")), F.lit("***"), F.lit(" #star"))), ",").alias("tags"))
)
plan(
    "o146_distinct_in_order",
    f"""SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS words FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents)) GROUP BY ALL) GROUP BY doc_id
        UNION ALL SELECT doc_id, '' FROM (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents) WHERE len(ws) = 0""",
)(lambda d: d.table("documents").select("doc_id", F.array_join(F.array_distinct(X.words(F.coalesce("text", F.lit("")))), " ").alias("words")))
plan("o170_clean_messages", f"SELECT conv_id, turn, {_strip(f'regexp_replace(regexp_replace(coalesce(text, {_quoted("")}), {_quoted(chr(92) + "s+")}, {_quoted(" ")}, {_quoted("g")}), {_quoted("[" + chr(92) + "x00-" + chr(92) + "x08" + chr(92) + "x0b" + chr(92) + "x0c" + chr(92) + "x0e-" + chr(92) + "x1f" + chr(92) + "x7f-" + chr(92) + "x{9f}]")}, {_quoted("")}, {_quoted("g")})')} AS t FROM conversations")(
    lambda d: d.table("conversations").select("conv_id", "turn", X.clean_message(F.col("text")).alias("t"))
)
_NOTAGS = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_PLAIN = _strip(f"regexp_replace({_NOTAGS}, '\\s+', ' ', 'g')")
plan("o171_plain_text", f"SELECT page_id, md5({_PLAIN}) AS h FROM pages")(lambda d: d.spread("pages").select("page_id", F.md5(X.without_tags(F.col("html"))).alias("h")))
plan("o171_first_words", f"SELECT page_id, CASE WHEN len(w) > 30 THEN concat(array_to_string(w[1:30], ' '), '...') ELSE array_to_string(w, ' ') END AS t FROM (SELECT page_id, {_words(_PLAIN)} AS w FROM pages)")(
    lambda d: d.table("pages").select("page_id", X.first_words(X.without_tags(F.col("html")), 30).alias("t"))
)
plan("o174_escaped", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS h FROM pages")(
    lambda d: d.table("pages").select("page_id", F.md5(X.escape_html(F.col("html"))).alias("h"))
)
plan("o177_learned_methods", "SELECT id, concat('learned_pattern_', regexp_replace(concat('learned_pattern_learned_pattern_', strategy), '^(learned_pattern_)+', '')) AS method FROM attempts")(
    lambda d: d.attempts.select("id", X.learned_method(F.concat(F.lit("learned_pattern_learned_pattern_"), "strategy")).alias("method"))
)
plan("o178_json_of_replies", "SELECT event_id, props AS j FROM events")(
    lambda d: d.table("events").select("event_id", X.json_of_reply(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done"))).alias("j"))
)
plan("o179_validated", "SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS confidence, coalesce(nullif(trim(event_type), ''), 'none') AS summary FROM events")(
    lambda d: d.table("events").select("event_id", F.to_json(F.struct((F.col("value") / 100).alias("confidence"), F.col("event_type").alias("summary"))).alias("j"))
    .select("event_id", F.from_json("j", "confidence double, summary string").alias("r"))
    .select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.confidence", F.lit(0.8)))).alias("confidence"), F.coalesce(F.nullif(F.trim("r.summary"), F.lit("")), F.lit("none")).alias("summary"))
)
plan("o180_markdown", None)(lambda d: d.spread("documents").select("doc_id", F.md5(X.markdown_to_html(F.concat(F.lit("# "), "text"))).alias("h")))
plan("o181_extractive_summary", None)(lambda d: d.spread("documents").select("doc_id", X.extractive_summary(F.col("text")).alias("summary")))
plan("o161_clean_entities", None)(lambda d: d.spread("pages").select("page_id", X.clean_entities(F.col("html")).alias("t")))
plan("o164_clean_urls", None)(lambda d: d.table("pages").select("page_id", X.clean_url(F.concat(F.lit("​"), "url", F.lit(" "))).alias("url")))
plan("o182_valid_summaries", None)(lambda d: d.spread_articles.select("id", X.is_summary_of(F.col("summary"), F.col("content")).alias("valid")))

plan("o069_bot_walls", f"SELECT id, length({_strip('content')}) < 500 AND {_any('lower(content)', S.BOT_WALL)} AS wall FROM articles")(lambda d: d.articles.select("id", S.is_bot_wall(F.col("content")).alias("wall")))
_T = "lower(concat(coalesce(title, ''), ' ', coalesce(content, '')))"
plan("o191_navigation", f"SELECT id, regexp_matches({_T}, {_re(S.NAVIGATION)}, 'i') AS navigation FROM articles")(lambda d: d.articles.select("id", S.is_navigation(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("navigation")))
plan("o193_spam", f"SELECT id, regexp_matches({_T}, {_re(S.SPAM)}, 'i') AS spam FROM articles")(lambda d: d.spread_articles.select("id", S.is_spam(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("spam")))
_LANG = "len(regexp_extract_all(content, '[a-zA-Z]')) + len(regexp_extract_all(content, '[а-яёА-ЯЁ]'))"
_CYR = "len(regexp_extract_all(content, '[а-яёА-ЯЁ]'))"
_LANG_OK = f"({_LANG} < 50 OR coalesce({_CYR}::DOUBLE / nullif({_LANG}, 0) >= 0.3, false) OR coalesce({_CYR}::DOUBLE / nullif({_LANG}, 0) <= 0.1, false))"
plan("o192_language", f"SELECT id, {_LANG_OK} AS ok FROM articles")(lambda d: d.articles.select("id", S.is_target_language(F.col("content")).alias("ok")))
_META = f"""(regexp_matches({_strip('lower(content)')}, {_re(p.replace(chr(92) + 'w', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]') for p in S.METADATA)}, 'i')
    OR length({_strip('content')}) < 100 AND len({_words('content')}) > 5 AND len(list_distinct(list_transform({_words('content')}, lambda w: lower(w)))) < 0.6 * len({_words('content')}))"""
plan("o194_metadata", f"SELECT id, {_META} AS metadata FROM articles")(lambda d: d.articles.select("id", S.is_metadata(F.col("content")).alias("metadata")))
_EXTRACTABLE = f"regexp_matches(url, '^https?://') AND NOT {_any('lower(url)', U.SKIP_DOMAINS)}"
_NEEDS = f"({_EXTRACTABLE} AND length({_strip('content')}) < 300 AND len({_words('content')}) < 50 AND (len({_words('title')}) >= 5 AND length({_strip('content')}) < 200 OR length({_strip('content')}) < 150))"
plan("o195_needs_extraction", f"SELECT id, {_NEEDS} AS needed FROM articles")(lambda d: d.articles.select("id", S.needs_extraction(F.col("title"), F.col("content"), F.col("url")).alias("needed")))
_KIND = "CASE source_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'telegram' ELSE 'extraction' END"
_SENT = "len(regexp_extract_all(content, '[.!?]+'))"
_N = f"len({_words('content')})"
_SCORE = f"""greatest(0.0, least(1.0, 0.5 + CASE WHEN length({_strip('title')}) > 20 THEN 0.1 ELSE 0.0 END + CASE WHEN {_SENT} BETWEEN 3 AND 50 THEN 0.15 WHEN {_SENT} > 50 THEN 0.05 ELSE 0.0 END
    + CASE WHEN len(list_filter(string_split(content, '\\n\\n'), lambda p: {_strip('p')} <> '')) >= 2 THEN 0.1 ELSE 0.0 END + CASE WHEN {_N} BETWEEN 50 AND 2000 THEN 0.1 WHEN {_N} > 2000 THEN 0.05 ELSE 0.0 END
    + CASE {_KIND} WHEN 'rss' THEN 0.05 WHEN 'telegram' THEN 0.02 WHEN 'extraction' THEN 0.1 ELSE 0.0 END
    - CASE WHEN regexp_matches(content, '[A-Z]{{10,}}') THEN 0.1 ELSE 0.0 END - CASE WHEN len(regexp_extract_all(content, '!{{2,}}')) > 3 THEN 0.1 ELSE 0.0 END))"""


def _typed(d: Domain):
    return d.spread_articles.withColumn("kind", F.expr(_KIND))


plan("o196_quality_score", f"SELECT id, round(CAST({_SCORE} AS DOUBLE), 4) AS score FROM articles")(lambda d: _typed(d).select("id", F.round(S.quality_score(F.col("title"), F.col("content"), F.col("kind")), 4).alias("score")))
plan(
    "o190_smart_filter",
    f"""SELECT id, CASE WHEN length({_strip('content')}) NOT BETWEEN 50 AND 50000 THEN 'too short' WHEN length(content) > 50000 THEN 'too long' WHEN length({_strip('title')}) < 10 THEN 'title too short'
        WHEN regexp_matches({_T}, {_re(S.NAVIGATION)}, 'i') THEN 'navigation' WHEN NOT {_LANG_OK} THEN 'language' WHEN regexp_matches({_T}, {_re(S.SPAM)}, 'i') THEN 'spam'
        WHEN {_META} AND NOT ({_EXTRACTABLE}) THEN 'metadata' WHEN n > 1 THEN 'duplicate' WHEN {_NEEDS} THEN 'needs extraction' WHEN {_META} AND {_EXTRACTABLE} THEN 'metadata, needs extraction'
        WHEN round(CAST({_SCORE} AS DOUBLE), 6) < CASE WHEN {_KIND} = 'extraction' THEN 0.35 ELSE 0.4 END THEN 'low quality' ELSE 'passed' END AS reason
        FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower({_strip('content')})) ORDER BY published_at, id) AS n FROM articles)""",
)(
    lambda d: S.with_filter_reason(
        mark_copies(_typed(d), F.md5(F.lower(X.strip(F.col("content")))), ["published_at", "id"], ["id"]), "title", "content", "url", "kind", F.col("is_copy")
    ).select("id", "reason")
)
_GS = f"list_filter(list_transform(string_split(content, '.'), lambda s: {_strip('s')}), lambda s: length(s) > 10)"
_LW = f"list_transform({_words('content')}, lambda w: lower(w))"
_LONG = f"list_filter({_LW}, lambda w: length(w) > 4)"
plan(
    "o197_good_content",
    f"""SELECT id, coalesce(length({_strip('content')}) >= 200 AND {_N}::DOUBLE / greatest(length(content), 1) BETWEEN 0.05 AND 0.5 AND len({_GS}) >= 2
        AND coalesce(list_sum(list_transform({_GS}, lambda s: length(s))), 0)::DOUBLE / greatest(len({_GS}), 1) >= 15 AND {_N} >= 10
        AND len(list_distinct(list_filter({_LW}, lambda w: length(w) > 3)))::DOUBLE / greatest({_N}, 1) >= 0.3 AND len(list_filter({_LW}, lambda w: {_any('w', S.NAV_WORDS)})) <= {_N} * 0.1
        AND coalesce(list_max(map_values(list_histogram({_LONG}))), 0) <= {_N} * 0.15 AND NOT {_any(f'lower({_strip("content")})', S.ERROR_TEXT)}, false) AS good FROM articles""".replace("list_histogram(", "list_aggregate(").replace(f"list_aggregate({_LONG})", f"list_aggregate({_LONG}, 'histogram')"),
)(lambda d: d.spread_articles.select("id", E.good("content").alias("good")))
plan("o198_content_assessment", None)(lambda d: d.spread_articles.select("id", F.round(S.assess_content(F.col("content")), 4).alias("score")))
plan("o203_suggested_category", f"SELECT ai_category, category_id, CASE WHEN ai_category IS NULL OR ai_category = '' THEN 'Other' {' '.join(f'WHEN {_any(chr(108) + "ower(ai_category)", ks)} THEN {_quoted(c)}' for c, ks in S.SUGGESTIONS)} ELSE 'Other' END AS suggested FROM article_categories")(
    lambda d: d.article_categories.select("ai_category", "category_id", S.suggested_category(F.col("ai_category")).alias("suggested"))
)
_RAW = "CASE id % 6 WHEN 0 THEN 'Tech|Business' WHEN 1 THEN 'Science and Tech' WHEN 2 THEN 'SPORT' WHEN 3 THEN 'Tech/Unknown' WHEN 4 THEN 'Serbia OR Other' ELSE 'Nothing' END"
plan("o199_parsed_categories", "SELECT id, CASE id % 6 WHEN 0 THEN 'Tech,Business' WHEN 1 THEN 'Science,Tech' WHEN 2 THEN 'Other' WHEN 3 THEN 'Tech' WHEN 4 THEN 'Serbia,Other' ELSE 'Other' END AS categories FROM articles")(
    lambda d: d.articles.select("id", F.array_join(S.parsed_categories(F.expr(_RAW), ("Serbia", "Tech", "Business", "Science", "Other")), ",").alias("categories"))
)
plan(
    "o204_content_kinds",
    "SELECT id, CASE " + " ".join(f"WHEN {' + '.join(f'CAST(regexp_matches({_T}, {_quoted(p)}, {_quoted("i")}) AS INT)' for p in ps)} >= 2 THEN {_quoted(k)}" for k, ps in S.CONTENT_KINDS.items()) + " ELSE 'general' END AS kind FROM articles",
)(lambda d: d.articles.select("id", S.content_kind(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("kind")))

_AGO = "CASE id % 5 WHEN 0 THEN concat(id % 9, ' days ago') WHEN 1 THEN 'Yesterday' WHEN 2 THEN concat(id % 7, ' weeks ago') WHEN 3 THEN 'last month' ELSE 'never' END"
plan("o224_relative_dates", f"SELECT id, CASE id % 5 WHEN 0 THEN {_TS} - to_days(CAST(id % 9 AS INT)) WHEN 1 THEN {_TS} - to_days(1) WHEN 2 THEN {_TS} - to_days(CAST(7 * (id % 7) AS INT)) WHEN 3 THEN {_TS} - to_days(30) END AS at FROM articles")(
    lambda d: d.articles.select("id", D.relative_date(F.expr(_AGO), AS_OF).alias("at"))
)
_FORMS = (("yyyy-MM-dd", "%Y-%m-%d"), ("MMMM d, yyyy", "%B %-d, %Y"), ("dd/MM/yyyy", "%d/%m/%Y"), ("d MMM yyyy", "%-d %b %Y"), ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"))
_WRITTEN = "CASE id % 5 " + " ".join(f"WHEN {i} THEN date_format(published_at, '{f}')" for i, (f, _) in enumerate(_FORMS)) + " END"
plan("o223_parsed_dates", "SELECT id, CASE WHEN id % 5 = 4 THEN published_at WHEN id % 5 = 2 AND day(published_at) <= 12 THEN CASE WHEN make_timestamp(2024, day(published_at), month(published_at), 0, 0, 0) <= " + _TS + " + INTERVAL 1 DAY THEN make_timestamp(2024, day(published_at), month(published_at), 0, 0, 0) ELSE date_trunc('day', published_at) END ELSE date_trunc('day', published_at) END::TIMESTAMP AS at FROM articles")(
    lambda d: d.articles.select("id", D.parse_date(F.expr(_WRITTEN), AS_OF).alias("at"))
)
plan("o221_date_strings", "SELECT id, id % 7 NOT IN (3, 5) AS looks FROM articles")(
    lambda d: d.articles.select("id", D.looks_like_date(F.expr(f"CASE id % 7 WHEN 3 THEN concat('number ', id, ' of many') WHEN 5 THEN '12:30' ELSE {_WRITTEN} END")).alias("looks"))
)
plan("o222_dates_in_text", "SELECT id, strftime(published_at, '%B %-d, %Y') AS found FROM articles")(
    lambda d: d.articles.select("id", D.date_in_text(F.concat(F.col("title"), F.lit(" Published: "), F.date_format("published_at", "MMMM d, yyyy"), F.lit(" end"))).alias("found"))
)
plan("o220_normalized_dates", "SELECT id, published_at - INTERVAL 2 HOUR AS at FROM articles")(
    lambda d: d.articles.select("id", D.feed_date([F.lit(None).cast("string"), F.concat(F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200"))], AS_OF).alias("at"))
)
plan("o006_feed_dates", f"SELECT id, CASE WHEN id % 3 = 0 THEN {_TS} ELSE published_at END AS at FROM articles")(
    lambda d: d.articles.select("id", D.feed_date([F.when(F.col("id") % 3 != 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")), F.lit("not a date")], AS_OF).alias("at"))
)
plan("o226_date_override", "SELECT id, CASE WHEN id % 3 = 0 THEN fetched_at ELSE published_at END AS at FROM articles")(
    lambda d: d.articles.select("id", D.override_date(F.when(F.col("id") % 3 != 0, F.col("published_at")), F.col("fetched_at")).alias("at"))
)
plan("o225_next_runs", "SELECT task_name, CASE schedule_type WHEN 'daily' THEN timestamp '2024-01-31 07:30:00' WHEN 'hourly' THEN timestamp '2024-01-31 00:15:00' ELSE timestamp '2024-01-31 00:45:00' END AS at FROM schedules")(
    lambda d: d.schedules.select(
        "task_name",
        D.next_run(F.col("schedule_type"), F.lit(8), F.when(F.col("schedule_type") == "daily", 30).otherwise(15), F.array().cast("array<int>"), "Europe/Belgrade", F.lit(45), AS_OF).alias("at"),
    )
)

_MEDIA_SPARK = "array(named_struct('url', concat(url, '/a.jpg'), 'type', 'image'), named_struct('url', concat(url, '/b.mp4'), 'type', 'video'), named_struct('url', concat(url, '/a.jpg'), 'type', 'image'))"
plan("o035_media_views", "SELECT page_id, 2::BIGINT AS images, 1::BIGINT AS videos, 0::BIGINT AS documents, concat(url, '/a.jpg') AS primary_image FROM pages")(
    lambda d: _pages(d).withColumn("m", F.expr(_MEDIA_SPARK)).withColumn("c", M.counts(F.col("m"))).select(
        "page_id", F.col("c.images").cast("long").alias("images"), F.col("c.videos").cast("long").alias("videos"), F.col("c.documents").cast("long").alias("documents"), M.primary_image(F.col("m"), F.lit(None).cast("string")).alias("primary_image")
    )
)
_SEVERAL = """concat(transform(sequence(0, cast(page_id % 5 as int)), i -> named_struct('url', concat(url, '/', i % 3, '.jpg'), 'type', 'image')), if(page_id % 3 = 0, array(named_struct('url', concat(url, '/b.mp4'), 'type', 'video')), array()),
    if(page_id % 2 = 0, array(named_struct('url', concat(url, '/c.pdf'), 'type', 'document'), named_struct('url', concat(url, '/c.pdf'), 'type', 'document')), array()))"""
plan("o303_media_counts", "SELECT page_id, least(page_id % 5 + 1, 3)::BIGINT AS images, (page_id % 3 = 0)::BIGINT AS videos, (page_id % 2 = 0)::BIGINT AS documents FROM pages")(
    lambda d: _pages(d).select("page_id", M.counts(M.distinct_by_url(F.expr(_SEVERAL))).alias("c")).select("page_id", *[F.col(f"c.{k}").cast("long").alias(k) for k in ("images", "videos", "documents")])
)
plan("o230_content_images", "SELECT page_id, concat(url, '?a=1&b=2') AS url, 'content_image_1.jpg' AS filename FROM pages")(
    lambda d: _pages(d).select("page_id", M.content_images(F.concat(F.lit("<p><img class='x' src=\""), "url", F.lit("?a=1&amp;b=2\" alt=''>")))[0].alias("i")).select("page_id", "i.url", "i.filename")
)
_LINKS = r'''regexp_extract_all(coalesce(html, ''), '(?i)<(?:img|video|source|audio|embed|iframe|a)\b[^>]*?\b(?:src|href)=["\']([^"\']+)["\']', 1)'''.replace("\\'", "''")
plan("o231_page_links", f"SELECT page_id, len(list_distinct({_LINKS}))::BIGINT AS links FROM pages")(lambda d: d.table("pages").select("page_id", F.size(M.links(F.col("html"))).cast("long").alias("links")))
plan("o005_feed_image", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat(url, '/e.jpg') ELSE concat(url, '/i.png') END AS image FROM pages")(
    lambda d: _pages(d).select(
        "page_id",
        F.coalesce(F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/e.jpg"))), F.lit(None).cast("string"), M.content_images(F.concat(F.lit("<img src='"), "url", F.lit("/i.png'>")))[0]["url"]).alias("image"),
    )
)

"""Queries: deduplication, upserts, label mapping, snapshot differences, deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.domain import AS_OF, Domain
from broadsheet.functions import scoring as S
from broadsheet.functions import text as X
from broadsheet.functions import variant as V
from broadsheet.operators import dedup as Q

from .registry import plan

#: Label rules in order; keys match as substrings either way. Settings of the queries, not of the operator.
RULES = (("europe", "International"), ("world", "International"), ("health", "Science"), ("sports", "Other"), ("law", "Politics"), ("climate", "Science"), ("news", "Other"), ("brass", "Tech"), ("steel", "Business"))
VALID = ("Serbia", "Tech", "Business", "Science", "Other")


def _rules(d: Domain):
    return d.spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(RULES)], "key string, target string, priority int")


_RULES_SQL = "(VALUES " + ", ".join(f"('{k}', '{t}', {i})" for i, (k, t) in enumerate(RULES)) + ") r(key, target, priority)"
_CASCADE = f"""WITH l AS (SELECT DISTINCT {{label}} AS label FROM {{table}}), m AS (SELECT ai_category, fixed_category FROM category_mapping WHERE is_active),
    p AS (SELECT l.label, arg_min(r.target, r.priority) AS t FROM l JOIN {_RULES_SQL} ON contains(lower(trim(l.label)), r.key) OR contains(r.key, lower(trim(l.label))) GROUP BY 1)
    SELECT l.label, CASE WHEN l.label IS NULL OR trim(l.label) = '' THEN 'Other' WHEN l.label IN ('Serbia', 'Tech', 'Business', 'Science', 'Other') THEN l.label
        ELSE coalesce(e.fixed_category, w.fixed_category, x.target, p.t, 'Other') END AS category,
      CASE WHEN l.label IS NULL OR trim(l.label) = '' THEN 'fallback' WHEN l.label IN ('Serbia', 'Tech', 'Business', 'Science', 'Other') THEN 'valid' WHEN e.fixed_category IS NOT NULL THEN 'exact'
        WHEN w.fixed_category IS NOT NULL THEN 'lower' WHEN x.target IS NOT NULL THEN 'rule' WHEN p.t IS NOT NULL THEN 'partial' ELSE 'fallback' END AS mapping_source
    FROM l LEFT JOIN m e ON l.label = e.ai_category LEFT JOIN m w ON lower(trim(l.label)) = lower(w.ai_category)
    LEFT JOIN {_RULES_SQL.replace(') r(', ') x(')} ON lower(trim(l.label)) = x.key LEFT JOIN p ON l.label = p.label"""
plan("o085_label_cascade", _CASCADE.format(label="ai_category", table="article_categories"))(
    lambda d: Q.map_labels(d.article_categories.select(F.col("ai_category").alias("label")), d.category_mapping.where("is_active"), _rules(d), list(VALID))
)
plan("o086_display_cascade", _CASCADE.format(label="p_type", table="part"))(lambda d: Q.map_labels(d.table("part").select(F.col("p_type").alias("label")), d.category_mapping.where("is_active"), _rules(d), list(VALID)))
plan(
    "o087_saved_category_ids",
    """SELECT b.article_id, b.category_id, coalesce(c.id, m.id, -1) AS saved_id FROM article_categories b LEFT JOIN categories c ON lower(b.ai_category) = lower(c.name)
       LEFT JOIN (SELECT x.ai_category, c.id FROM category_mapping x JOIN categories c ON lower(c.name) = x.ai_category WHERE x.is_active) m ON lower(replace(b.ai_category, ' news', '')) = m.ai_category""",
)(
    lambda d: d.article_categories.select("article_id", "category_id", F.lower("ai_category").alias("k"), F.lower(F.replace("ai_category", F.lit(" news"), F.lit(""))).alias("k2"))
    .join(d.categories.select(F.lower("name").alias("k"), F.col("id").alias("own")), "k", "left")
    .join(d.category_mapping.where("is_active").select(F.col("ai_category").alias("k2")).join(d.categories.select(F.lower("name").alias("k2"), F.col("id").alias("mapped")), "k2"), "k2", "left")
    .select("article_id", "category_id", F.coalesce("own", "mapped", F.lit(-1)).alias("saved_id"))
)
plan("o072_snapshot_diff", "SELECT page_id, md5(url) AS h FROM pages WHERE md5(url) NOT IN (SELECT md5(concat('https://', source, '.example.org/', doc_id)) FROM documents)")(
    lambda d: Q.new_items(d.table("pages").select("page_id", F.md5("url").alias("h")), d.articles.select(F.md5("url").alias("h")), "h").select("page_id", "h")
)
_ESCAPE = lambda t: f"""concat('"', array_to_string(list_transform(string_split(coalesce({t}, ''), ''), lambda c: CASE WHEN c = '' THEN '' WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN unicode(c) = 8 THEN '\\b' WHEN unicode(c) = 9 THEN '\\t'
    WHEN unicode(c) = 10 THEN '\\n' WHEN unicode(c) = 12 THEN '\\f' WHEN unicode(c) = 13 THEN '\\r' WHEN unicode(c) >= 65536 THEN printf('\\u%04x\\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024)
    WHEN unicode(c) < 32 OR unicode(c) > 126 THEN printf('\\u%04x', unicode(c)) ELSE c END), ''), '"')"""  # noqa: E731
plan("o243_item_hashes", f"""SELECT id, md5(concat('{{"description": ', {_ESCAPE('substring(content, 1, 100)')}, ', "link": ', {_ESCAPE('url')}, ', "title": ', {_ESCAPE('title')}, '}}')) AS h FROM articles""")(lambda d: d.articles.select("id", Q.item_hash(F.col("title"), F.col("url"), F.col("content")).alias("h")))
plan("o147_titles_once", "SELECT id FROM articles QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY id) = 1")(
    lambda d: d.articles.groupBy(F.lower("title")).agg(F.min("id").alias("id")).select("id")
)
plan("o144_exact_copies", "SELECT id, row_number() OVER (PARTITION BY md5(lower(regexp_replace(content, '^\\s+|\\s+$', '', 'g'))) ORDER BY published_at, id) > 1 AS duplicate FROM articles")(
    lambda d: Q.mark_copies(d.articles.select("id", "published_at", F.md5(F.lower(X.strip(F.col("content")))).alias("h")), F.col("h"), ["published_at", "id"], ["id"]).select("id", F.col("is_copy").alias("duplicate"))
)
plan(
    "o144_window_copies",
    """WITH RECURSIVE h AS (SELECT id, published_at AS t, md5(lower(regexp_replace(content, '^\\s+|\\s+$', '', 'g'))) AS hash FROM articles),
       s AS (SELECT id, t, hash, row_number() OVER (PARTITION BY hash ORDER BY t, id) AS n FROM h),
       f AS (SELECT id, t, hash, n, t AS kept_at, false AS duplicate FROM s WHERE n = 1
             UNION ALL SELECT s.id, s.t, s.hash, s.n, CASE WHEN s.t < f.kept_at + INTERVAL 24 HOUR THEN f.kept_at ELSE s.t END, s.t < f.kept_at + INTERVAL 24 HOUR FROM f JOIN s ON f.hash = s.hash AND s.n = f.n + 1)
       SELECT id, duplicate FROM f""",
)(lambda d: Q.window_duplicates(d.articles.select("id", F.col("published_at").alias("at"), F.md5(F.lower(X.strip(F.col("content")))).alias("hash"))))
plan(
    "o141_greedy_batch",
    """WITH RECURSIVE k AS (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n, list_concat(['u' || url, 'uk' || id % 997], CASE WHEN trim(title) <> '' THEN ['t' || lower(trim(title))] ELSE [] END) AS keys FROM articles),
       f AS (SELECT source_id, id, n, keys AS seen, true AS kept FROM k WHERE n = 1
             UNION ALL SELECT k.source_id, k.id, k.n, CASE WHEN list_has_any(f.seen, k.keys) THEN f.seen ELSE list_concat(f.seen, k.keys) END, NOT list_has_any(f.seen, k.keys) FROM f JOIN k ON k.source_id = f.source_id AND k.n = f.n + 1)
       SELECT id FROM f WHERE kept""",
)(
    lambda d: Q.greedy_by_source(d.articles.select("source_id", F.col("id").alias("seq"), "id", "title", F.array("url", F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("urls")))
)
_INCOMING = "SELECT doc_id AS seq, concat('https://', source, '.example.org/', doc_id) AS u1, CASE WHEN doc_id % 4 = 0 THEN concat('https://', source, '.example.org/', doc_id + 1) END AS u2, CASE WHEN doc_id % 3 > 0 THEN upper(source) ELSE '' END AS title, CASE WHEN doc_id % 5 > 0 THEN text END AS content FROM documents"
plan(
    "o142_merged_rows",
    f"""WITH i AS ({_INCOMING}), e AS (SELECT seq, u1 AS url FROM i UNION SELECT seq, u2 FROM i WHERE u2 IS NOT NULL),
       h AS (SELECT e.seq, min(a.id) AS id FROM e JOIN articles a ON a.url = e.url GROUP BY 1),
       l AS (SELECT h.id, arg_max(i.title, i.seq) FILTER (i.title <> '') AS title, arg_max(i.content, i.seq) FILTER (i.content <> '') AS content FROM h JOIN i ON i.seq = h.seq GROUP BY 1)
       SELECT a.id, coalesce(l.title, a.title) AS title, md5(coalesce(l.content, a.content)) AS h FROM articles a JOIN l ON a.id = l.id WHERE NOT coalesce(a.processed AND a.summary IS NOT NULL AND a.summary <> '', false)""",
)(
    lambda d: Q.merge_by_url(d.articles, d.spark.sql(_INCOMING.replace("FROM documents", "FROM {documents}"), documents=d.table("documents")).withColumn("urls", F.array("u1", "u2")), ["title", "content"]).select("id", "title", F.md5("content").alias("h"))
)
plan(
    "o143_recent_titles",
    "SELECT a.id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM articles b WHERE b.source_id = a.source_id AND lower(b.title) = lower(a.title) AND b.id < a.id AND b.fetched_at >= a.fetched_at - INTERVAL 168 HOUR)",
)(
    lambda d: Q.without_recent_titles(d.articles.select("id", "source_id", "title", "fetched_at")).select("id")
)
plan("o140_upsert", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")(
    lambda d: Q.upsert(
        d.table("orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at")),
        d.table("orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at")), ["o_custkey"], "at",
    ).select("o_custkey", "o_orderkey", "o_totalprice")
)
plan("o020_insert_new", "SELECT DISTINCT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")(lambda d: Q.insert_new(d.table("customer").select(F.col("c_custkey").alias("k")), d.table("orders").select(F.col("o_custkey").alias("k")), ["k"]))
plan("o110_upsert_stats", "SELECT date, CAST(sum(articles_processed) AS BIGINT) * 2 AS articles_processed FROM processing_stats GROUP BY 1")(
    lambda d: Q.accumulate(d.processing_stats.groupBy("date").agg(F.sum("articles_processed").alias("articles_processed")), d.processing_stats, "date", ["articles_processed"])
)
_HIT = "coalesce(lower(ai_category) = 'nation_6 news', false)"
plan("o148_remap", f"SELECT article_id, CASE WHEN {_HIT} THEN 3 ELSE category_id END AS category_id FROM article_categories")(
    lambda d: d.article_categories.select("article_id", F.when(F.coalesce(F.lower("ai_category") == "nation_6 news", F.lit(False)), 3).otherwise(F.col("category_id")).alias("category_id"))
)
plan(
    "o149_remap_with_collisions",
    f"SELECT article_id, category_id, ai_category FROM (SELECT article_id, CASE WHEN {_HIT} THEN 3 ELSE category_id END AS category_id, confidence, ai_category, {_HIT} AS hit FROM article_categories) QUALIFY row_number() OVER (PARTITION BY article_id, category_id ORDER BY hit DESC, confidence DESC NULLS LAST, ai_category) = 1",
)(lambda d: Q.remap(d.article_categories, "Nation_6 news", 3).select("article_id", "category_id", "ai_category"))
plan("o150_replaced_categories", "SELECT article_id, category_id FROM article_categories WHERE article_id % 2 = 1 UNION ALL SELECT doc_id, doc_id % 7 FROM documents WHERE doc_id % 2 = 0")(
    lambda d: d.article_categories.select("article_id", "category_id").join(_fresh(d).select("article_id").distinct(), "article_id", "left_anti").unionByName(_fresh(d).dropDuplicates(["article_id", "category_id"]))
)


def _fresh(d: Domain):
    return d.table("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("article_id"), (F.col("doc_id") % 7).alias("category_id"))


plan("o151_cascade_delete", "SELECT b.article_id, b.category_id FROM article_categories b JOIN articles a ON b.article_id = a.id WHERE a.source_id NOT IN (SELECT id FROM news_sources WHERE NOT enabled)")(
    lambda d: d.article_categories.select("article_id", "category_id").join(
        d.articles.select("id", "source_id").join(d.news_sources.where("NOT enabled").select(F.col("id").alias("source_id")), "source_id").select(F.col("id").alias("article_id")), "article_id", "left_anti"
    )
)
plan("o084_correlated_delete", "SELECT article_id, category_id, ai_category FROM article_categories b WHERE NOT (lower(ai_category) = 'nation_12' AND EXISTS (SELECT 1 FROM article_categories c WHERE c.article_id = b.article_id AND c.category_id = 3))")(
    lambda d: d.article_categories.select("article_id", "category_id", "ai_category").where("coalesce(lower(ai_category) <> 'nation_12', true)").unionByName(
        d.article_categories.select("article_id", "category_id", "ai_category").where("lower(ai_category) = 'nation_12'").join(d.article_categories.where("category_id = 3").select("article_id"), "article_id", "left_anti")
    )
)
plan("o152_merged_feeds", f"SELECT id, url FROM articles WHERE published_at >= timestamp '{AS_OF}' - INTERVAL 480 HOUR AND url NOT IN (SELECT url FROM pages)")(
    lambda d: d.articles.where("lang = 'en'").unionByName(d.articles.where("lang <> 'en'")).where(f"published_at >= timestamp_ntz'{AS_OF}' - interval 480 hours").select("id", "url").join(d.table("pages").select("url"), "url", "left_anti").select("id", "url")
)
_COMPOSITE = """concat(a.n_name, CASE a.id % 8 WHEN 0 THEN '|' WHEN 1 THEN ' / ' WHEN 2 THEN ', ' WHEN 3 THEN ' and ' WHEN 4 THEN ' & ' WHEN 5 THEN ' + ' WHEN 6 THEN ', x|' ELSE ' | ' END,
    CASE WHEN a.id % 3 = 0 THEN 'Unheard of' WHEN a.id % 7 = 0 THEN lower(b.n_name) ELSE b.n_name END, CASE WHEN a.id % 5 = 0 THEN '|' ELSE '' END)"""
_LABELLED = f"SELECT a.id, CASE WHEN a.id % 11 = 0 THEN 'One/two' ELSE {_COMPOSITE} END AS label FROM (SELECT doc_id AS id, n_name FROM {{documents}} JOIN {{nation}} ON n_nationkey = doc_id % 25) a JOIN (SELECT doc_id AS id, n_name FROM {{documents}} JOIN {{nation}} ON n_nationkey = (doc_id * 3 + 1) % 25) b ON a.id = b.id"
plan(
    "o153_backfill",
    f"""WITH l AS ({_LABELLED.format(documents='documents', nation='nation')}), c AS (SELECT id, name FROM categories UNION ALL SELECT -1, 'Other'),
       s AS (SELECT id, CASE WHEN contains(label, '|') THEN string_split(label, '|') WHEN contains(label, '/') THEN string_split(label, '/') WHEN contains(label, ',') THEN string_split(label, ',')
                WHEN contains(label, ' and ') THEN string_split(label, ' and ') WHEN contains(label, ' & ') THEN string_split(label, ' & ') END AS parts FROM l),
       p AS (SELECT id, trim(unnest(parts)) AS name FROM s WHERE parts IS NOT NULL),
       f AS (SELECT DISTINCT p.id AS article_id, c.id AS category_id FROM p JOIN c ON p.name = c.name)
       SELECT article_id, category_id FROM f UNION ALL SELECT id, -1 FROM s WHERE parts IS NOT NULL AND id NOT IN (SELECT article_id FROM f)
       UNION ALL SELECT article_id, category_id FROM article_categories WHERE article_id NOT IN (SELECT id FROM s WHERE parts IS NOT NULL)""",
)(
    lambda d: Q.backfilled(
        d.article_categories, d.spark.sql(_LABELLED, documents=d.table("documents"), nation=d.table("nation")),
        d.categories.select("id", "name").unionByName(d.spark.createDataFrame([(-1, "Other")], "id long, name string")),
    )
)
_CANDIDATES = {0: ("Tech", "Business"), 1: ("Science", "Serbia", "Other"), 2: ("Business", "Other", "Health", "Science"), 3: ("Health",)}


def _candidates(d: Domain):
    chosen = F.when(F.lit(False), F.array(F.lit("")))
    for k, names in _CANDIDATES.items():
        chosen = chosen.when(F.col("id") % 4 == k, F.array(*map(F.lit, names)))
    return d.articles.select("id", S.keyword_text(F.col("title"), F.col("content")).alias("t"), chosen.alias("c"))


_TEXT = f"concat(CASE WHEN title <> '' THEN concat(lower(title), ' ') ELSE '' END, lower(substring(coalesce(content, ''), 1, {S.KEYWORD_CHARS})))"
_KW = lambda c: " + ".join(f"CASE WHEN contains(t, '{k}') THEN {len(k.split())} ELSE 0 END" for k in S.KEYWORDS.get(c, ())) or "0"
_ROWS = " UNION ALL ".join(f"SELECT id, '{c}' AS category, {_KW(c)} AS score, {i} AS place, {len(cs)} AS n FROM x WHERE id % 4 = {k}" for k, cs in _CANDIDATES.items() for i, c in enumerate(cs))
plan(
    "o200_best_category",
    f"""WITH x AS (SELECT id, {_TEXT} AS t FROM articles), r AS ({_ROWS}), m AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM r)
       SELECT id, arg_min(category, CASE WHEN top > 0 AND n > 1 THEN place - score * 100 ELSE coalesce(list_position({list(S.PRIORITY)}, category), 100) * 10 + place END) AS category FROM m GROUP BY id""",
)(lambda d: _candidates(d).select("id", S.best_category(F.col("t"), F.col("c")).alias("category")))
plan(
    "o201_category_confidences",
    f"""WITH x AS (SELECT id, {_TEXT} AS t FROM articles), r AS ({_ROWS}),
       s AS (SELECT *, CASE WHEN n = 1 THEN 1.0 WHEN sum(score) OVER (PARTITION BY id) = 0 THEN 0.7 - 0.1 * place WHEN score > 0 THEN 0.6 + score::DOUBLE / sum(score) OVER (PARTITION BY id) * 0.4 ELSE 0.3 END::DOUBLE AS c FROM r)
       SELECT id, category, round(c, 2) AS confidence, row_number() OVER (PARTITION BY id ORDER BY round(c, 2) DESC, place) - 1 AS place FROM s WHERE round(c, 2) >= 0.3""",
)(lambda d: _candidates(d).select("id", F.posexplode(S.category_confidences(F.col("t"), F.col("c"))).alias("place", "x")).select("id", F.col("x.name").alias("category"), F.round("x.confidence", 2).alias("confidence"), F.col("place").cast("long").alias("place")))
_POINTS = {c: " + ".join(f"CASE WHEN contains(t, '{k}') THEN {3 - i} ELSE 0 END" for i, tier in enumerate(tiers) for k in (x.replace("'", "''") for x in tier)) for c, tiers in S.WEIGHTED.items()}
plan(
    "o202_fallback_category",
    f"""WITH x AS (SELECT id, lower(concat(coalesce(title, ''), ' ', coalesce(content, ''))) AS t FROM articles),
       r AS ({" UNION ALL ".join(f"SELECT id, '{c}' AS category, {points} AS score, {i} AS place FROM x" for i, (c, points) in enumerate(_POINTS.items()))})
       SELECT id, CASE WHEN max(score) >= 2 THEN arg_max(category, score * 100 - place) ELSE 'Other' END AS category FROM r GROUP BY id""",
)(lambda d: d.articles.select("id", S.fallback_category(F.col("title"), F.col("content")).alias("category")))
_ITEMS = """SELECT l_orderkey AS page, concat('https://l', l_orderkey, '.example/list/?all#top') AS base,
    CASE WHEN l_returnflag = 'N' AND l_partkey % 3 > 0 THEN concat('https://l', l_orderkey, '.example/list?page=', l_linenumber) WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN '' WHEN l_returnflag = 'R' THEN NULL
         ELSE concat('https://l', l_orderkey, '.example/', l_partkey % 2, '/?x') END AS link, repeat('d', CAST(l_quantity AS INT) * 120) AS description FROM """
_BARE = "rtrim(regexp_replace({}, '[?#].*$', ''), '/')"
plan(
    "o213_list_page_fallback",
    f"""WITH i AS ({_ITEMS} lineitem), b AS (SELECT page, CASE WHEN link <> '' THEN {_BARE.format("link")} END AS link, {_BARE.format("base")} AS base, length(description) AS chars FROM i)
       SELECT page, count(*) FILTER (link IS NULL OR link = base) > 0.5 * count(*) OR count(DISTINCT link) = 1 AND count(*) > 1 OR count(*) = 1 AND max(chars) > 5000 AS is_fallback FROM b GROUP BY page""",
)(lambda d: Q.list_page_fallback(d.spark.sql(_ITEMS + "{lineitem}", lineitem=d.table("lineitem"))))
#: Raw data of an event: nothing, flags of several types, confidences as numbers, text and what is neither.
_RAW = """CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN '{"is_advertisement": true, "ad_confidence": 0.75, "ad_type": "native", "ad_markers": ["x", 1]}' WHEN 2 THEN '{"is_advertisement": "false", "ad_confidence": "0.5"}'
    WHEN 3 THEN '{"advertising_detection": {}, "ad_reasoning": "none", "ad_confidence": null}' WHEN 4 THEN '{"is_advertisement": 1, "ad_confidence": "high", "ad_type": "banner"}' WHEN 5 THEN '{"is_advertisement": []}'
    WHEN 6 THEN '{"ad_type": "lost", "ad_confidence": 1}' WHEN 7 THEN 'not json' END"""
plan(
    "o214_merged_fields",
    """SELECT event_id, CASE WHEN k IN (1, 2, 4) THEN true WHEN k IN (3, 5) THEN false ELSE user_id % 2 = 0 END AS is_advertisement, CASE k WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.0 ELSE 0.25 END::DOUBLE AS ad_confidence,
         CASE WHEN k = 1 THEN 'native' ELSE 'old' END AS ad_type, CASE WHEN k = 3 THEN 'none' END AS ad_reasoning, CASE WHEN k = 1 THEN '["x",1]' END AS ad_markers, k IN (1, 2, 3, 5) AS ad_processed
       FROM (SELECT *, event_id % 9 AS k FROM events)""",
)(
    lambda d: d.table("events").select(
        "event_id", V.ad_fields(F.expr(_RAW), F.col("user_id") % 2 == 0, F.lit(0.25), F.lit("old"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)).alias("f")
    ).select("event_id", "f.*")
)
plan("o264_daily_window", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")(
    lambda d: d.table("events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("w.start").cast("string").alias("day"), "n", "total")
)

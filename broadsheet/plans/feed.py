"""Queries: feeds, search, filters, joins and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.domain import AS_OF, Domain
from broadsheet.operators import feed as O
from broadsheet.operators.ranking import first_per
from broadsheet.operators.search import SearchIndex
from broadsheet.shared import shared_path

from .registry import plan

_TS = f"timestamp '{AS_OF}'"


@plan("o001_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(d: Domain):
    return d.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@plan("o002_named_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def _(d: Domain):
    return d.spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least", args={"status": "F", "least": 1000}, orders=d.table("orders"))


@plan("o003_count", "SELECT count(*) AS n FROM articles WHERE processed")
def _(d: Domain):
    return d.articles.where("processed").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "o030_feed_projection",
    """SELECT id, url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS domain, title, coalesce(summary, '') AS summary,
              CASE WHEN length(content) > 500 THEN concat(substring(content, 1, 500), '...') ELSE content END AS content, source_id, published_at FROM articles""",
)
def _(d: Domain):
    from broadsheet.functions.urls import domain_of

    return d.articles.select("id", "url", domain_of(F.col("url")).alias("domain"), "title", F.coalesce("summary", F.lit("")).alias("summary"), O.clip(F.col("content")).alias("content"), "source_id", "published_at")


_FEED = f"""SELECT a.id, a.url, a.title, a.source_id, a.published_at FROM articles a
    WHERE a.published_at >= {_TS} - INTERVAL 168 HOUR AND a.is_advertisement <> true
      AND EXISTS (SELECT 1 FROM article_categories b JOIN categories c ON b.category_id = c.id WHERE b.article_id = a.id AND lower(c.name) = 'nation_6')
    ORDER BY a.published_at DESC NULLS FIRST, a.id LIMIT 50"""


def feed_public(d: Domain):
    chosen = d.articles.where(O.since_hours("published_at", AS_OF, 168) & O.not_advertisement())
    chosen = O.with_category(chosen, d.article_categories, d.categories, "NATION_6")
    return O.page(chosen.select("id", "url", "title", "source_id", "published_at"), [F.col("published_at").desc_nulls_first(), F.col("id")], 50)


plan("o133_feed_public", _FEED)(feed_public)


@plan("o132_feed_api", "SELECT id, title, fetched_at FROM articles ORDER BY fetched_at DESC NULLS FIRST, id LIMIT 100 OFFSET 20")
def _(d: Domain):
    return O.page(d.articles.select("id", "title", "fetched_at"), [F.col("fetched_at").desc_nulls_first(), F.col("id")], 100, 20)


@plan(
    "o074_page_with_categories",
    """WITH p AS (SELECT id, title, fetched_at FROM articles ORDER BY fetched_at DESC NULLS FIRST, id LIMIT 100),
       n AS (SELECT b.article_id, string_agg(c.name, ',' ORDER BY -coalesce(confidence, 0.0), category_id) AS names, first(c.name ORDER BY -coalesce(confidence, 0.0), category_id) AS first_name
             FROM article_categories b JOIN categories c ON b.category_id = c.id GROUP BY 1)
       SELECT p.id, p.title, p.fetched_at, coalesce(names, '') AS category_names, coalesce(first_name, 'Other') AS primary_category FROM p LEFT JOIN n ON p.id = n.article_id""",
)
def _(d: Domain):
    page = O.page(d.articles.select("id", "title", "fetched_at"), [F.col("fetched_at").desc_nulls_first(), F.col("id")], 100)
    return O.categories_of_page(page, d.article_categories, d.categories).select("id", "title", "fetched_at", "category_names", "primary_category")


@plan("o032_confidence_rules", "SELECT article_id, category_id, CASE WHEN confidence IS NULL OR confidence = 0 THEN 1.0 ELSE confidence END AS from_list, coalesce(confidence, 0.0) AS to_show FROM article_categories")
def _(d: Domain):
    c = F.col("confidence")
    return d.article_categories.select("article_id", "category_id", O.confidence_from_list(c).alias("from_list"), O.confidence_to_show(c).alias("to_show"))


@plan(
    "o033_primary_category_feed",
    """SELECT a.id, coalesce(arg_min(c.display_name, c.id), 'Other') AS primary_category FROM articles a LEFT JOIN article_categories b ON a.id = b.article_id LEFT JOIN categories c ON b.category_id = c.id GROUP BY a.id""",
)
def _(d: Domain):
    named = d.article_categories.join(d.categories, F.col("category_id") == F.col("id"))
    first = named.groupBy(F.col("article_id").alias("id")).agg(F.min_by("display_name", "category_id").alias("primary_category"))
    return d.articles.select("id").join(first, "id", "left").select("id", F.coalesce("primary_category", F.lit("Other")).alias("primary_category"))


@plan(
    "o034_primary_category_model",
    """WITH r AS (SELECT b.article_id, c.name, row_number() OVER (PARTITION BY article_id ORDER BY coalesce(confidence, 0.0) DESC, category_id) AS n FROM article_categories b JOIN categories c ON b.category_id = c.id)
       SELECT a.id, coalesce(r.name, 'Other') AS primary_category FROM articles a LEFT JOIN r ON a.id = r.article_id AND n = 1""",
)
def _(d: Domain):
    best = O.primary_category(d.article_categories, d.categories).withColumnRenamed("article_id", "id")
    return d.articles.select("id").join(best, "id", "left").select("id", F.coalesce("primary_category", F.lit("Other")).alias("primary_category"))


@plan("o037_category_config", "SELECT lower(name) AS k, coalesce(display_name, name) AS display_name, coalesce(color, '#6c757d') AS color FROM categories")
def _(d: Domain):
    entry = F.struct(F.lower("name").alias("k"), F.struct(F.coalesce("display_name", "name").alias("display_name"), F.coalesce("color", F.lit("#6c757d")).alias("color")).alias("v"))
    config = d.categories.agg(F.map_from_entries(F.collect_list(entry)).alias("config"))
    return config.select(F.explode("config").alias("k", "v")).select("k", "v.display_name", "v.color")


_COUNTS = "SELECT s.id, s.name, s.source_type, count(a.id) AS articles FROM news_sources s {join} articles a ON s.id = a.source_id {where} GROUP BY ALL"


@plan("o038_source_listing", _COUNTS.format(join="LEFT JOIN", where=""))
def _(d: Domain):
    return O.source_counts(d.articles, d.news_sources, keep_empty=True, enabled_only=False)


plan("o083_source_counts_decorrelated", "SELECT s.id, s.name, s.source_type, (SELECT count(*) FROM articles a WHERE a.source_id = s.id) AS articles FROM news_sources s")(lambda d: O.source_counts(d.articles, d.news_sources, True, False))
plan("o076_source_counts_with_zeros", _COUNTS.format(join="LEFT JOIN", where="WHERE s.enabled"))(lambda d: O.source_counts(d.articles, d.news_sources, keep_empty=True))
plan("o075_enabled_source_counts", _COUNTS.format(join="JOIN", where="WHERE s.enabled"))(lambda d: O.source_counts(d.articles, d.news_sources))


@plan("o106_source_counts", f"SELECT name, articles FROM ({_COUNTS.format(join='JOIN', where='WHERE s.enabled')}) UNION ALL SELECT 'all', count(*) FROM articles")
def _(d: Domain):
    total = d.articles.agg(F.count(F.lit(1)).alias("articles")).select(F.lit("all").alias("name"), "articles")
    return O.source_counts(d.articles, d.news_sources).select("name", "articles").unionByName(total)


@plan(
    "o040_prompt_blocks",
    """WITH r AS (SELECT b.category_id, a.id, concat(a.title, chr(10), substring(coalesce(nullif(a.summary, ''), a.content), 1, 800)) AS block, row_number() OVER (PARTITION BY b.category_id ORDER BY a.published_at DESC, a.id) AS n
                  FROM articles a JOIN article_categories b ON a.id = b.article_id)
       SELECT category_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS prompt FROM r WHERE n <= 10 GROUP BY 1""",
)
def _(d: Domain):
    from pyspark.sql import Window

    a = d.articles.select(F.col("id").alias("article_id"), "published_at", F.concat("title", F.lit("\n"), F.substring(F.coalesce(F.nullif("summary", F.lit("")), "content"), 1, 800)).alias("block"))
    n = F.row_number().over(Window.partitionBy("category_id").orderBy(F.col("published_at").desc(), "article_id"))
    keys = d.article_categories.select("category_id", "article_id").join(d.articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    first = keys.withColumn("n", n).where("n <= 10").select("category_id", "article_id", "n")  # texts are fetched for the ten that are shown only
    return first.join(a.drop("published_at"), "article_id").groupBy("category_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("prompt"))


@plan(
    "o039_telegraph_payload",
    """WITH r AS (SELECT b.category_id, a.title, a.url, row_number() OVER (PARTITION BY b.category_id ORDER BY a.published_at DESC, a.id) AS n FROM articles a JOIN article_categories b ON a.id = b.article_id)
       SELECT category_id, string_agg(concat(title, ' ', url), chr(10) ORDER BY n) AS links, count(*) AS n FROM r WHERE n <= 10 GROUP BY 1""",
)
def _(d: Domain):
    from pyspark.sql import Window

    rows = d.article_categories.select("category_id", "article_id").join(d.articles.select(F.col("id").alias("article_id"), "title", "url", "published_at"), "article_id")
    n = F.row_number().over(Window.partitionBy("category_id").orderBy(F.col("published_at").desc(), "article_id"))
    first = rows.withColumn("n", n).where("n <= 10")
    entry = F.sort_array(F.collect_list(F.struct("n", F.concat_ws(" ", "title", "url").alias("line"))))
    return first.groupBy("category_id").agg(F.array_join(F.transform(entry, lambda x: x["line"]), "\n").alias("links"), F.count(F.lit(1)).alias("n"))


@plan(
    "o041_prompt_categories",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY fixed_category ORDER BY usage_count DESC, ai_category) AS n FROM category_mapping WHERE is_active)
       SELECT fixed_category, concat(fixed_category, ' - e.g.: ', string_agg(ai_category, ', ' ORDER BY n)) AS line FROM r WHERE n <= 5 GROUP BY 1""",
)
def _(d: Domain):
    top = first_per(d.category_mapping.where("is_active"), ["fixed_category"], [F.col("usage_count").desc(), F.col("ai_category")], 5, "n")
    names = F.transform(F.sort_array(F.collect_list(F.struct("n", "ai_category"))), lambda x: x["ai_category"])
    return top.groupBy("fixed_category").agg(names.alias("names")).select("fixed_category", F.concat("fixed_category", F.lit(" - e.g.: "), F.array_join("names", ", ")).alias("line"))


plan("o130_top_mappings", "SELECT fixed_category, ai_category, usage_count FROM category_mapping QUALIFY row_number() OVER (PARTITION BY fixed_category ORDER BY usage_count DESC, ai_category) <= 5")(
    lambda d: first_per(d.category_mapping, ["fixed_category"], [F.col("usage_count").desc(), F.col("ai_category")], 5).select("fixed_category", "ai_category", "usage_count")
)
plan("o050_published_since", f"SELECT id, published_at FROM articles WHERE published_at >= {_TS} - INTERVAL 24 HOUR")(lambda d: d.articles.where(O.since_hours("published_at", AS_OF, 24)).select("id", "published_at"))
plan("o051_hide_ads", "SELECT id FROM articles WHERE is_advertisement <> true")(lambda d: d.articles.where(O.not_advertisement()).select("id"))
plan("o052_category_advertisements", "SELECT id FROM articles WHERE is_advertisement = true")(lambda d: O.with_category(d.articles, d.article_categories, d.categories, "advertisements").select("id"))
plan("o053_category_list", "SELECT id FROM articles WHERE id IN (SELECT article_id FROM article_categories b JOIN categories c ON b.category_id = c.id WHERE lower(c.name) IN ('nation_6', 'nation_12'))")(
    lambda d: O.in_categories(d.articles, d.article_categories, d.categories, "Nation_6, NATION_12").select("id")
)
plan("o082_category_semi_join", "SELECT id, title FROM articles WHERE id IN (SELECT article_id FROM article_categories WHERE category_id IN (SELECT id FROM categories WHERE lower(name) IN ('nation_18')))")(
    lambda d: O.in_categories(d.articles, d.article_categories, d.categories, "nation_18").select("id", "title")
)
plan("o054_source_ids", "SELECT id FROM articles WHERE source_id IN (1, 7)")(lambda d: O.from_sources(d.articles, d.news_sources, "1,abc,7").select("id"))
plan("o054_source_names", "SELECT id FROM articles WHERE source IN ('src2', 'src3')")(lambda d: O.from_sources(d.articles, d.news_sources, "src2,src3").select("id"))
_SEARCH = " AND ".join(f"(coalesce(title ILIKE '%{t}%', false) OR coalesce(summary ILIKE '%{t}%', false) OR coalesce(content ILIKE '%{t}%', false))" for t in ("the", "and"))
_RELEVANCE = "CASE WHEN title ILIKE '%the and%' THEN 3 WHEN summary ILIKE '%the and%' THEN 2 ELSE 1 END"
plan("o055_keyword_search", f"SELECT id FROM articles WHERE {_SEARCH}")(lambda d: d.articles.where(O.matches("the a AND")).select("id"))


@plan("o134_search_by_relevance", f"SELECT id, {_RELEVANCE} AS relevance, published_at FROM articles WHERE {_SEARCH} ORDER BY {_RELEVANCE} DESC, published_at DESC NULLS FIRST, id LIMIT 100")
def _(d: Domain):
    found = d.articles.where(O.matches("the and")).select("id", O.relevance("the and").alias("relevance"), "published_at")
    return O.page(found, [F.col("relevance").desc(), F.col("published_at").desc_nulls_first(), F.col("id")], 100)


plan("o134_search_by_date", f"SELECT id, published_at FROM articles WHERE {_SEARCH} ORDER BY published_at DESC NULLS FIRST, id LIMIT 100")(
    lambda d: O.page(d.articles.where(O.matches("the and")).select("id", "published_at"), [F.col("published_at").desc_nulls_first(), F.col("id")], 100)
)
plan("o134_search_by_title", f"SELECT id, title FROM articles WHERE {_SEARCH} ORDER BY title, id LIMIT 100")(lambda d: O.page(d.articles.where(O.matches("the and")).select("id", "title"), [F.col("title"), F.col("id")], 100))
plan("o135_search_total", f"SELECT count(*) AS total, count(*) > 120 AS has_more FROM articles WHERE {_SEARCH}")(
    lambda d: d.articles.where(O.matches("the and")).agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > 120)
)
def _rare(tokens: tuple[str, ...]) -> str:
    return " AND ".join(f"(coalesce(title ILIKE '%{t}%', false) OR coalesce(summary ILIKE '%{t}%', false) OR coalesce(content ILIKE '%{t}%', false))" for t in tokens)


def _indexed(d: Domain) -> SearchIndex:
    """All articles, twenty ids a block."""
    return SearchIndex.build(d.articles, shared_path(d.spark, "search"), 20)


plan("o055_indexed_search", f"SELECT id FROM articles WHERE {_rare(('achlich', 'in'))}")(lambda d: _indexed(d).search("ACHLICH a in").select("id"))


@plan(
    "o134_indexed_by_relevance",
    f"""SELECT id, CASE WHEN title ILIKE '%ach_eit%' THEN 3 WHEN summary ILIKE '%ach_eit%' THEN 2 ELSE 1 END AS relevance, published_at FROM articles WHERE {_rare(('ach_eit',))}
        ORDER BY relevance DESC, published_at DESC NULLS FIRST, id LIMIT 100""",
)
def _(d: Domain):
    found = _indexed(d).search("ach_eit").select("id", O.relevance("ach_eit").alias("relevance"), "published_at")
    return O.page(found, [F.col("relevance").desc(), F.col("published_at").desc_nulls_first(), F.col("id")], 100)


plan("o135_indexed_total", f"SELECT count(*) AS total, count(*) > 20 AS has_more FROM articles WHERE {_rare(('achkeit',))}")(
    lambda d: _indexed(d).search("Achkeit").agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > 20)
)
plan(
    "o205_display_score",
    """SELECT id, CASE WHEN contains(lower(coalesce(title, '')), 'the and') THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(summary, '')), 'the and') THEN 2 ELSE 0 END
              + CASE WHEN contains(lower(coalesce(content, '')), 'the and') THEN 1 ELSE 0 END AS score FROM articles""",
)(lambda d: d.articles.select("id", O.display_score("The and").alias("score")))


@plan(
    "o036_search_hits",
    f"""SELECT id, CASE WHEN contains(lower(coalesce(title, '')), 'the and') THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(summary, '')), 'the and') THEN 2 ELSE 0 END
              + CASE WHEN contains(lower(coalesce(content, '')), 'the and') THEN 1 ELSE 0 END AS score, len(regexp_extract_all(content, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1)) AS n_images
        FROM articles WHERE {_SEARCH}""",
)
def _(d: Domain):
    from broadsheet.functions.media import content_images

    return d.articles.where(O.matches("the and")).select("id", O.display_score("the and").alias("score"), F.size(content_images(F.col("content"))).cast("long").alias("n_images"))


plan("o056_unprocessed", "SELECT id FROM articles WHERE summary_processed = false OR category_processed = false OR ad_processed = false OR processed = false OR (summary IS NULL AND content IS NOT NULL)")(
    lambda d: d.articles.where("summary_processed = false OR category_processed = false OR ad_processed = false OR processed = false OR (summary IS NULL AND content IS NOT NULL)").select("id")
)
plan("o057_limiter_window", "SELECT id, published_at FROM articles WHERE published_at >= timestamp '2024-01-05' AND published_at <= timestamp '2024-01-20' ORDER BY published_at, id LIMIT 200")(
    lambda d: O.page(d.articles.where("published_at >= timestamp_ntz'2024-01-05' AND published_at <= timestamp_ntz'2024-01-20'").select("id", "published_at"), [F.col("published_at"), F.col("id")], 200)
)
plan("o139_processing_batch", "SELECT id, published_at FROM articles WHERE processed = false ORDER BY published_at, id LIMIT 100")(
    lambda d: O.page(d.articles.where("processed = false").select("id", "published_at"), [F.col("published_at"), F.col("id")], 100)
)
plan(
    "o058_failed_extractions",
    "SELECT id, title FROM articles WHERE (title = summary OR trim(title) = trim(summary)) AND url NOT LIKE '%t.me%' AND length(coalesce(content, '')) < 1000 ORDER BY published_at DESC NULLS FIRST, id LIMIT 100",
)(
    lambda d: O.page(
        d.articles.where("(title = summary OR trim(title) = trim(summary)) AND url NOT LIKE '%t.me%' AND length(coalesce(content, '')) < 1000").select("id", "title", "published_at"),
        [F.col("published_at").desc_nulls_first(), F.col("id")], 100,
    ).drop("published_at")
)
plan("o060_sources", "SELECT count(*) FILTER (enabled) AS enabled, count(*) FILTER (error_count > 0) AS with_errors FROM news_sources")(
    lambda d: d.news_sources.agg(F.count_if("enabled").alias("enabled"), F.count_if(F.col("error_count") > 0).alias("with_errors"))
)
plan("o062_on_a_date", "SELECT id FROM articles WHERE CAST(fetched_at AS DATE) = DATE '2024-01-10'")(lambda d: d.articles.where("fetched_at >= timestamp_ntz'2024-01-10' AND fetched_at < timestamp_ntz'2024-01-11'").select("id"))
plan("o061_patterns_kept", "SELECT id FROM patterns WHERE success_count > 0 OR failure_count < 5")(lambda d: d.patterns.where("success_count > 0 OR failure_count < 5").select("id"))
plan("o063_due_tasks", f"SELECT task_name FROM schedules WHERE enabled AND NOT is_running AND next_run <= {_TS}")(lambda d: d.schedules.where(F.expr("enabled AND NOT is_running") & (F.col("next_run") <= O.instant(AS_OF))).select("task_name"))
plan("o064_stuck_tasks", f"SELECT task_name FROM schedules WHERE is_running AND (last_run < {_TS} - INTERVAL 4 HOUR OR last_run IS NULL)")(
    lambda d: d.schedules.where(F.col("is_running") & ((F.col("last_run") < O.instant(AS_OF) - F.expr("interval 4 hours")) | F.col("last_run").isNull())).select("task_name")
)
plan("o065_retryable", f"SELECT id FROM dead_letters WHERE retry_count < 3 AND {_TS} - coalesce(last_retry, first_failed) >= INTERVAL 300 SECOND")(
    lambda d: d.dead_letters.where((F.col("retry_count") < 3) & (F.coalesce("last_retry", "first_failed") <= O.instant(AS_OF) - F.expr("interval 300 seconds"))).select("id")
)
plan("o070_valid_summaries", "SELECT id FROM daily_summaries WHERE length(trim(summary_text)) >= 20")(lambda d: d.daily_summaries.where("length(trim(summary_text)) >= 20").select("id"))
plan("o071_labelled", "SELECT article_id, category_id FROM article_categories WHERE ai_category IS NOT NULL AND ai_category <> ''")(lambda d: d.article_categories.where("ai_category IS NOT NULL AND ai_category <> ''").select("article_id", "category_id"))
plan("o281_source_filter", "SELECT id FROM news_sources WHERE error_count > 0 AND (contains(lower(name), 'src1') OR contains(lower(url), 'src1'))")(
    lambda d: d.news_sources.where("error_count > 0 AND (contains(lower(name), 'src1') OR contains(lower(url), 'src1'))").select("id")
)
plan("o073_article_categories", "SELECT a.id, c.name, b.confidence FROM articles a JOIN article_categories b ON a.id = b.article_id JOIN categories c ON b.category_id = c.id")(
    lambda d: d.articles.select("id").join(d.article_categories, F.col("id") == F.col("article_id")).join(d.categories.select(F.col("id").alias("category_id"), "name"), "category_id").select("id", "name", "confidence")
)
plan("o077_unmapped", "SELECT b.ai_category, count(*) AS articles FROM article_categories b LEFT JOIN category_mapping m ON lower(b.ai_category) = lower(m.ai_category) WHERE m.ai_category IS NULL GROUP BY 1")(lambda d: O.unmapped(d.article_categories, d.category_mapping))
plan("o114_unmapped_counts", "SELECT b.ai_category, count(*) AS articles FROM article_categories b LEFT JOIN category_mapping m ON lower(b.ai_category) = lower(m.ai_category) WHERE m.ai_category IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda d: O.page(O.unmapped(d.article_categories, d.category_mapping), [F.col("articles").desc(), F.col("ai_category")], 20)
)
_EXAMPLES = """WITH u AS (SELECT b.ai_category, count(*) AS articles FROM article_categories b LEFT JOIN category_mapping m ON lower(b.ai_category) = lower(m.ai_category) WHERE m.ai_category IS NULL GROUP BY 1),
    t AS (SELECT DISTINCT b.ai_category, a.title FROM article_categories b JOIN articles a ON b.article_id = a.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY ai_category ORDER BY title) AS n FROM t)
    SELECT u.ai_category, any_value(u.articles) AS articles, string_agg(r.title, ' | ' ORDER BY r.title) AS examples FROM u LEFT JOIN r ON u.ai_category = r.ai_category AND r.n <= 5 GROUP BY 1"""
plan("o078_unmapped_examples", _EXAMPLES)(lambda d: O.top_titles(O.unmapped(d.article_categories, d.category_mapping), d.article_categories, d.articles))
plan("o115_first_titles", _EXAMPLES)(lambda d: O.top_titles(O.unmapped(d.article_categories, d.category_mapping), d.article_categories, d.articles))
_BY_CATEGORY = "SELECT lower(c.name) AS name, count(b.article_id) AS articles FROM categories c LEFT JOIN article_categories b ON c.id = b.category_id GROUP BY 1"
plan("o079_category_counts", _BY_CATEGORY)(lambda d: O.category_counts(d.article_categories, d.categories))
plan("o105_category_counts", f"{_BY_CATEGORY} UNION ALL SELECT 'all', count(*) FROM articles")(
    lambda d: O.category_counts(d.article_categories, d.categories).unionByName(d.articles.agg(F.count(F.lit(1)).alias("articles")).select(F.lit("all").alias("name"), "articles"))
)
plan("o092_top_category", f"SELECT * FROM ({_BY_CATEGORY}) ORDER BY articles DESC, name LIMIT 1")(lambda d: O.page(O.category_counts(d.article_categories, d.categories), [F.col("articles").desc(), F.col("name")], 1))
plan("o271_top_categories", f"SELECT * FROM ({_BY_CATEGORY}) ORDER BY articles DESC, name LIMIT 12")(lambda d: O.page(O.category_counts(d.article_categories, d.categories), [F.col("articles").desc(), F.col("name")], 12))
plan("o080_by_source_type", "SELECT s.source_type, count(*) AS articles FROM articles a JOIN news_sources s ON a.source_id = s.id GROUP BY 1")(
    lambda d: d.articles.select("source_id").join(d.news_sources.select(F.col("id").alias("source_id"), "source_type"), "source_id").groupBy("source_type").agg(F.count(F.lit(1)).alias("articles"))
)
plan("o088_by_source_name", "SELECT a.id, s.id AS source FROM articles a JOIN news_sources s ON a.source = s.name")(
    lambda d: d.articles.select(F.col("id").alias("article"), "source").join(d.news_sources.select("id", "name"), F.col("source") == F.col("name")).select(F.col("article").alias("id"), F.col("id").alias("source"))
)


@plan(
    "o031_article_documents",
    """SELECT a.id, a.title, coalesce(string_agg(concat(c.name, '=', CAST(round(coalesce(b.confidence, 0.0) * 100) AS INTEGER)), ';' ORDER BY c.id), '') AS categories, a.content
       FROM articles a LEFT JOIN article_categories b ON a.id = b.article_id LEFT JOIN categories c ON b.category_id = c.id GROUP BY a.id, a.title, a.content""",
)
def _(d: Domain):
    entry = F.struct("category_id", F.concat("name", F.lit("="), F.round(O.confidence_to_show(F.col("confidence")) * 100).cast("int").cast("string")).alias("e"))
    named = d.article_categories.join(d.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    nested = named.groupBy(F.col("article_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]), ";").alias("categories"))
    return d.articles.select("id", "title", "content").join(nested, "id", "left").select("id", "title", F.coalesce("categories", F.lit("")).alias("categories"), "content")


@plan("o012_feed_items", "SELECT id, regexp_replace(regexp_replace(title, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS title, url, published_at FROM articles ORDER BY published_at DESC NULLS LAST, id LIMIT 50")
def _(d: Domain):
    """What the written feed holds, read back by Spark's XML reader."""
    from broadsheet.sources import feeds

    folder = shared_path(d.spark, "feed")
    feeds.write_feed(d.articles, folder, "Latest", "https://example.org")
    rows = d.spark.read.schema("title string, link string, pubDate string").format("xml").option("rowTag", "item").load(folder)
    stamp = F.to_timestamp(F.regexp_replace("pubDate", r"^\w+, | [-+]\d{4}$", ""), "dd MMM yyyy HH:mm:ss").cast("timestamp_ntz")
    return rows.select(F.substring_index("link", "/", -1).cast("long").alias("id"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.col("link").alias("url"), stamp.alias("published_at"))

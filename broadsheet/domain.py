"""The content-aggregation tables, derived from the generic tables of a data folder.

`Domain(spark, folder)` gives each as a DataFrame; `SQL` has the same definitions for DuckDB, as
common table expressions over the generic tables. Instants are explicit: `AS_OF` is the end of the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.shared import spread

AS_OF = "2024-01-31 00:00:00"

#: Of each table: the generic table(s) in Spark SQL, and the projection in both dialects where it is the same.
_HOURS = {"spark": "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast({} as int), 0, 0)", "duckdb": "(timestamp '2024-01-01 00:00:00' + to_hours(cast({} as integer)))"}
_JSON_K = {"spark": "cast(get_json_object(props, '$.k') as bigint)", "duckdb": "cast(json_extract_string(props, '$.k') as bigint)"}
#: Where parts are null, DuckDB's concat goes on without them.
_URL = {"spark": "concat_ws('', 'https://', d.source, '.example.org/', d.doc_id)", "duckdb": "concat('https://', d.source, '.example.org/', d.doc_id)"}
#: Days are ISO text.
_DATE = {"spark": "cast(cast({} as date) as string)", "duckdb": "cast(cast({} as date) as varchar)"}


def _definitions(dialect: str) -> dict[str, str]:
    hours, json_k = _HOURS[dialect].format, _JSON_K[dialect]
    return {
        "articles": f"""
            SELECT d.doc_id AS id, {_URL[dialect]} AS url, substring(d.text, 1, 80) AS title, d.text AS content,
                   CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE substring(d.text, 1, 200) END AS summary,
                   cast(substring(d.source, 4) AS bigint) AS source_id, d.source AS source, d.lang AS lang, (l.toxic = 1) AS is_advertisement,
                   {hours('d.doc_id * 37 % 720')} AS published_at, {hours('d.doc_id * 41 % 720')} AS fetched_at,
                   CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.doc_id % 3 <> 0 END AS summary_processed, d.doc_id % 5 <> 1 AS category_processed,
                   d.doc_id % 2 = 0 AS ad_processed, d.doc_id % 11 <> 0 AS processed
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
        "news_sources": """
            SELECT DISTINCT cast(substring(source, 4) AS bigint) AS id, source AS name, concat('https://', source, '.example.org') AS url,
                   CASE cast(substring(source, 4) AS bigint) % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'telegram' ELSE 'page' END AS source_type,
                   cast(substring(source, 4) AS bigint) % 5 <> 0 AS enabled, cast(substring(source, 4) AS bigint) % 4 AS error_count
            FROM documents""",
        "categories": """
            SELECT cast(n_nationkey AS bigint) AS id, n_name AS name, concat('the ', lower(n_name)) AS display_name,
                   CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE '#00aa00' END AS color, r_name AS region
            FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "article_categories": """
            SELECT article_id, category_id, confidence, CASE WHEN article_id % 3 = 0 THEN n_name WHEN article_id % 3 = 1 THEN lower(n_name) ELSE concat(n_name, ' news') END AS ai_category
            FROM (
                SELECT doc_id AS article_id, doc_id % 25 AS category_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE cast((doc_id * 13) % 100 AS double) / 100 END AS confidence FROM documents
                UNION ALL
                SELECT doc_id AS article_id, (doc_id * 7 + 3) % 25 AS category_id, cast((doc_id * 29) % 100 AS double) / 100 AS confidence FROM documents WHERE doc_id % 25 <> (doc_id * 7 + 3) % 25
            ) x JOIN nation ON category_id = n_nationkey""",
        "category_mapping": """
            SELECT lower(n_name) AS ai_category, r_name AS fixed_category, n_nationkey % 6 <> 5 AS is_active, cast(n_nationkey * 7 % 11 AS bigint) AS usage_count
            FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "attempts": """
            SELECT event_id AS id, ts AS created_at, concat('d', user_id % 20, '.example') AS domain, event_type AS strategy, event_type <> 'error' AS success, value AS extraction_time_ms,
                   CASE WHEN event_type = 'view' THEN NULL ELSE value / 500 END AS quality_score, cast(floor(value * 3) AS bigint) AS content_length, user_id % 4 = 0 AS user_ai
            FROM events""",
        "ai_usage": f"""
            SELECT event_id AS id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE ts END AS created_at, concat('d', user_id % 40, '.example') AS domain, event_type AS analysis_type,
                   {json_k} AS tokens_used, value / 1000000 AS cost, event_id % 3 AS patterns_discovered
            FROM events""",
        "patterns": """
            SELECT p_partkey AS id, concat('d', p_partkey % 40, '.example') AS domain, concat('.', lower(p_brand), '-', p_partkey) AS selector, p_type AS strategy,
                   cast(p_size AS bigint) AS success_count, p_partkey % 13 AS failure_count, p_partkey % 9 AS consecutive_successes, p_partkey % 5 AS consecutive_failures, p_retailprice AS quality_score_avg,
                   CASE p_partkey % 3 WHEN 0 THEN 'ai' WHEN 1 THEN 'manual' ELSE 'heuristic' END AS discovered_by, CASE p_partkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'content' WHEN 2 THEN 'date' ELSE 'author' END AS role
            FROM part""",
        "daily_summaries": f"""
            SELECT doc_id AS id, {_DATE[dialect].format(hours('doc_id * 37 % 720'))} AS date, concat(coalesce(lang, ''), '-', coalesce(source, '')) AS category, CASE WHEN doc_id % 19 = 0 THEN ' - ' ELSE substring(text, 1, 400) END AS summary_text,
                   doc_id % 20 AS articles_count, {hours('doc_id * 53 % 720')} AS created_at
            FROM documents""",
        "processing_stats": f"""
            SELECT {_DATE[dialect].format('o_orderdate')} AS date, cast(o_orderkey % 50 AS bigint) AS articles_processed, cast(o_custkey % 40 AS bigint) AS api_calls_made, cast(o_orderkey % 3 AS bigint) AS errors_count,
                   o_totalprice / 1000 AS processing_time_seconds
            FROM orders""",
        "schedules": f"""
            SELECT s_name AS task_name, s_suppkey % 4 <> 0 AS enabled, s_suppkey % 5 = 0 AS is_running, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE {hours('720 - s_suppkey % 9')} END AS last_run,
                   {hours('700 + s_suppkey % 40')} AS next_run, CASE s_suppkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'hourly' ELSE 'interval' END AS schedule_type
            FROM supplier""",
        "dead_letters": """
            SELECT event_id AS id, event_type AS reason, user_id % 5 AS retry_count, ts AS first_failed, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS last_retry FROM events""",
    }


#: DuckDB common table expressions of all tables: start a query with `WITH {SQL}, ...` or select from them.
SQL = ", ".join(f"{name} AS ({body})" for name, body in _definitions("duckdb").items())


def sql(query: str) -> str:
    """A DuckDB query over the domain tables; a leading `WITH` of its own goes on from theirs."""
    query = query.strip()
    if query.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {SQL}, {query[14:]}"
    return f"WITH {SQL}, {query[5:]}" if query[:5].upper() == "WITH " else f"WITH {SQL} {query}"


class Domain:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A generic table as it is stored."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A generic table over all cores, for columns that take much time a row."""
        return spread(self.table(name))

    def _derived(self, name: str, spreading: bool = False, **given: DataFrame) -> DataFrame:
        body, read = _definitions("spark")[name], self.spread if spreading else self.table
        tables = [t for t in ("documents", "labels", "nation", "region", "events", "part", "orders", "supplier") if f" {t}" in body]
        return self.spark.sql(_braced(body, tables), **{t: given[t] if t in given else read(t) for t in tables})

    articles = cached_property(lambda self: self._derived("articles"))
    spread_articles = cached_property(lambda self: self._derived("articles", True))
    #: Articles whose texts are cut to the length of titles before anything is shuffled.
    titled_articles = cached_property(lambda self: self._derived("articles", documents=self.table("documents").withColumn("text", F.substring("text", 1, 80))))
    news_sources = cached_property(lambda self: self._derived("news_sources"))
    categories = cached_property(lambda self: self._derived("categories"))
    article_categories = cached_property(lambda self: self._derived("article_categories"))
    category_mapping = cached_property(lambda self: self._derived("category_mapping"))
    attempts = cached_property(lambda self: self._derived("attempts"))
    ai_usage = cached_property(lambda self: self._derived("ai_usage"))
    patterns = cached_property(lambda self: self._derived("patterns"))
    daily_summaries = cached_property(lambda self: self._derived("daily_summaries"))
    processing_stats = cached_property(lambda self: self._derived("processing_stats"))
    schedules = cached_property(lambda self: self._derived("schedules"))
    dead_letters = cached_property(lambda self: self._derived("dead_letters"))


def _braced(body: str, tables: list[str]) -> str:
    """The tables' names after FROM and JOIN as parameters of spark.sql."""
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", body)

"""Queries: statistics, usage, rankings and maintenance filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.domain import AS_OF, Domain
from broadsheet.operators import feed as O
from broadsheet.operators import ranking as R
from broadsheet.operators import stats as S

from .registry import plan

_TS = f"timestamp '{AS_OF}'"
_TODAY = f"fetched_at >= date_trunc('day', {_TS} - INTERVAL 1 SECOND)"
_DASH = f"""SELECT count(*) AS total, count(*) FILTER ({_TODAY}) AS today, count(*) FILTER (fetched_at >= {_TS} - INTERVAL 168 HOUR) AS last_days, count(*) FILTER (processed) AS processed,
    count(*) FILTER ({_TODAY} AND processed) AS processed_today, count(*) FILTER (is_advertisement) AS advertisements FROM articles"""


@plan(
    "o090_dashboard",
    f"""SELECT *, round(CASE WHEN total > 0 THEN processed::DOUBLE / total * 100 ELSE 0 END, 4) AS processed_rate, round(CASE WHEN total > 0 THEN advertisements::DOUBLE / total * 100 ELSE 0 END, 4) AS advertisement_rate,
        round_even(today / 24.0, 0) AS articles_per_hour FROM ({_DASH})""",
)
def _(d: Domain):
    return S.dashboard(d.articles, AS_OF)


plan("o091_rates", "SELECT source, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (processed)::DOUBLE / count(*) * 100 ELSE 0 END, 4) AS processed_rate FROM articles GROUP BY 1")(
    lambda d: d.articles.groupBy("source").agg(F.round(S.share(F.count_if("processed"), F.count(F.lit(1))), 4).alias("processed_rate"))
)


@plan(
    "o093_day_totals",
    """SELECT date, CAST(coalesce(sum(articles_processed), 0) AS BIGINT) AS processed, CAST(coalesce(sum(api_calls_made), 0) AS BIGINT) AS calls, CAST(coalesce(sum(errors_count), 0) AS BIGINT) AS errors,
              CASE WHEN sum(articles_processed) > 0 THEN CAST(floor(round(sum(processing_time_seconds), 6) / sum(articles_processed) * 1000) AS BIGINT) ELSE 0 END AS avg_ms,
              CASE WHEN sum(api_calls_made) > 0 THEN round_even((sum(api_calls_made) - sum(errors_count))::DOUBLE / sum(api_calls_made) * 100, 0) ELSE 0 END AS success_rate
       FROM processing_stats GROUP BY 1""",
)
def _(d: Domain):
    sums = d.processing_stats.groupBy("date").agg(
        F.coalesce(F.sum("articles_processed"), F.lit(0)).alias("processed"), F.coalesce(F.sum("api_calls_made"), F.lit(0)).alias("calls"), F.coalesce(F.sum("errors_count"), F.lit(0)).alias("errors"),
        F.round(F.sum("processing_time_seconds"), 6).alias("seconds"),
    )
    return sums.select(
        "date", "processed", "calls", "errors",
        F.when(F.col("processed") > 0, F.floor(F.col("seconds") / F.col("processed") * 1000)).otherwise(F.lit(0).cast("long")).alias("avg_ms"),
        F.when(F.col("calls") > 0, F.bround((F.col("calls") - F.col("errors")).cast("double") / F.col("calls") * 100.0)).otherwise(0.0).alias("success_rate"),
    )


_USAGE = "count(*) AS calls, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens, round(coalesce(sum(cost), 0.0), 6) AS cost, CAST(coalesce(sum(patterns_discovered), 0) AS BIGINT) AS patterns"
plan("o094_ai_usage_total", f"SELECT {_USAGE} FROM ai_usage WHERE created_at >= {_TS} - INTERVAL 720 HOUR OR created_at IS NULL")(lambda d: S.usage(S.usage_window(d.ai_usage, AS_OF, 30)))
plan("o095_ai_usage_by_type", f"SELECT analysis_type, {_USAGE} FROM ai_usage GROUP BY 1 ORDER BY tokens DESC")(lambda d: S.usage(d.ai_usage, ["analysis_type"]).orderBy(F.col("tokens").desc()))
plan("o096_ai_usage_daily", f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, {_USAGE} FROM ai_usage WHERE created_at IS NOT NULL GROUP BY 1")(
    lambda d: S.usage(d.ai_usage.where("created_at IS NOT NULL"), [F.to_date("created_at").cast("string").alias("day")])
)
plan("o097_ai_usage_top_domains", f"SELECT domain, {_USAGE} FROM ai_usage GROUP BY 1 ORDER BY tokens DESC, domain LIMIT 10")(lambda d: O.page(S.usage(d.ai_usage, ["domain"]), [F.col("tokens").desc(), F.col("domain")], 10))
plan("o098_ai_usage_today", f"SELECT {_USAGE} FROM ai_usage WHERE created_at >= {_TS} - INTERVAL 24 HOUR")(lambda d: S.usage(d.ai_usage.where(O.since_hours("created_at", AS_OF, 24))))
plan("o099_extraction_week", f"SELECT count(*) AS n, CAST(sum(CASE WHEN length(content) > 100 THEN 1 ELSE 0 END) AS BIGINT) AS extracted, round(avg(CASE WHEN content IS NOT NULL THEN length(content) ELSE 0 END), 4) AS avg_length FROM articles WHERE fetched_at >= {_TS} - INTERVAL 168 HOUR")(
    lambda d: d.articles.where(O.since_hours("fetched_at", AS_OF, 168)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.length("content") > 100, 1).otherwise(0)).alias("extracted"), F.round(F.avg(F.coalesce(F.length("content"), F.lit(0))), 4).alias("avg_length"))
)
_FIG = """count(*) AS attempts, count(*) FILTER (success) AS successes, round(count(*) FILTER (success)::DOUBLE / count(*) * 100, 2) AS success_rate, round(avg(extraction_time_ms), 5) AS avg_time,
    round(avg(quality_score), 5) AS avg_quality, count(*) FILTER (user_ai) AS ai_count"""
plan("o100_domain_success_rates", f"SELECT domain, {_FIG} FROM attempts WHERE created_at >= {_TS} - INTERVAL 168 HOUR GROUP BY 1 ORDER BY attempts DESC, domain LIMIT 20")(
    lambda d: O.page(S.extraction_figures(d.attempts.where(O.since_hours("created_at", AS_OF, 168)), "domain"), [F.col("attempts").desc(), F.col("domain")], 20)
)
plan("o101_recent_performance", f"SELECT domain, strategy, {_FIG} FROM attempts WHERE created_at >= {_TS} - INTERVAL 168 HOUR GROUP BY 1, 2")(lambda d: S.extraction_figures(d.attempts.where(O.since_hours("created_at", AS_OF, 168)), "domain", "strategy"))
plan("o300_strategy_rates", f"SELECT strategy, {_FIG} FROM attempts GROUP BY 1")(lambda d: S.extraction_figures(d.attempts, "strategy"))
plan("o300_error_domains", "SELECT domain, count(*) AS errors FROM attempts WHERE NOT success GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda d: O.page(d.attempts.where("NOT success").groupBy("domain").agg(F.count(F.lit(1)).alias("errors")), [F.col("errors").desc(), F.col("domain")], 10)
)
plan("o301_efficiency", "SELECT count(DISTINCT domain) AS domains, count(*) AS attempts, round(count(*) FILTER (success)::DOUBLE / count(*) * 100, 2) AS rate, count(*) FILTER (user_ai) AS ai FROM attempts")(
    lambda d: d.attempts.agg(F.countDistinct("domain").alias("domains"), F.count(F.lit(1)).alias("attempts"), F.round(S.share(F.count_if("success"), F.count(F.lit(1))), 2).alias("rate"), F.count_if("user_ai").alias("ai"))
)
plan("o102_ai_analytics", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, analysis_type, count(*) AS n, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost, round(avg(tokens_used), 4) AS avg_tokens FROM ai_usage WHERE created_at IS NOT NULL GROUP BY 1, 2")(
    lambda d: d.ai_usage.where("created_at IS NOT NULL").groupBy(F.to_date("created_at").cast("string").alias("day"), "analysis_type").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_used").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.avg("tokens_used"), 4).alias("avg_tokens"))
)
plan("o103_pattern_effectiveness", "SELECT strategy, discovered_by, count(*) AS n, CAST(sum(success_count) AS BIGINT) AS successes, CAST(sum(failure_count) AS BIGINT) AS failures, round(avg(quality_score_avg), 2) AS quality FROM patterns GROUP BY 1, 2")(
    lambda d: d.patterns.groupBy("strategy", "discovered_by").agg(F.count(F.lit(1)).alias("n"), F.sum("success_count").alias("successes"), F.sum("failure_count").alias("failures"), F.round(F.avg("quality_score_avg"), 2).alias("quality"))
)
_DOMAINS = "SELECT DISTINCT domain FROM attempts"
plan(
    "o104_domain_patterns",
    f"SELECT s.domain, count(p.id) AS patterns, round(coalesce(avg(p.quality_score_avg), 0), 4) AS quality, max(p.success_count) AS best FROM (SELECT DISTINCT domain FROM ai_usage) s LEFT JOIN patterns p ON s.domain = p.domain GROUP BY 1",
)(
    lambda d: d.ai_usage.select("domain").distinct().join(
        d.patterns.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg("quality_score_avg").alias("q"), F.max("success_count").alias("best")), "domain", "left"
    ).select("domain", F.coalesce("n", F.lit(0).cast("long")).alias("patterns"), F.round(F.coalesce("q", F.lit(0.0)), 4).alias("quality"), "best")
)
plan("o081_domains_without_patterns", "SELECT s.domain, count(p.id) AS patterns FROM (SELECT DISTINCT domain FROM attempts) s LEFT JOIN patterns p ON s.domain = p.domain GROUP BY 1")(
    lambda d: d.attempts.select("domain").distinct().join(d.patterns.groupBy("domain").agg(F.count(F.lit(1)).alias("patterns")), "domain", "left").na.fill(0, ["patterns"])
)
plan(
    "o107_source_type_performance",
    """SELECT s.source_type, count(*) AS n, round(avg(length(coalesce(a.content, ''))), 4) AS avg_length, count(*) FILTER (a.title = a.summary) AS failed, round((1 - count(*) FILTER (a.title = a.summary)::DOUBLE / count(*)) * 100, 4) AS success_rate
       FROM articles a JOIN news_sources s ON a.source_id = s.id GROUP BY 1""",
)(
    lambda d: d.articles.select("source_id", F.length(F.coalesce("content", F.lit(""))).alias("n_chars"), (F.col("title") == F.col("summary")).alias("bad"))
    .join(d.news_sources.select(F.col("id").alias("source_id"), "source_type"), "source_id").groupBy("source_type")
    .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_length"), F.count_if("bad").alias("failed"), F.round((1 - F.count_if("bad").cast("double") / F.count(F.lit(1))) * 100.0, 4).alias("success_rate"))
)
_CONTENT = "count(*) AS n, count(*) FILTER (length(coalesce(content, '')) < 200) AS short, count(*) FILTER (title = summary) AS failed"
plan("o059_content_counts", f"SELECT {_CONTENT} FROM articles")(lambda d: d.articles.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.coalesce("content", F.lit(""))) < 200).alias("short"), F.count_if(F.col("title") == F.col("summary")).alias("failed")))
plan("o108_content_stats", f"SELECT *, round((1 - short::DOUBLE / n) * 100, 4) AS long_rate, round((1 - failed::DOUBLE / n) * 100, 4) AS good_rate FROM (SELECT {_CONTENT} FROM articles)")(
    lambda d: d.articles.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.coalesce("content", F.lit(""))) < 200).alias("short"), F.count_if(F.col("title") == F.col("summary")).alias("failed"))
    .withColumns({"long_rate": F.round((1 - F.col("short").cast("double") / F.col("n")) * 100.0, 4), "good_rate": F.round((1 - F.col("failed").cast("double") / F.col("n")) * 100.0, 4)})
)
_DAYS = "SELECT date, CAST(sum(articles_processed) AS BIGINT) AS processed, CAST(sum(api_calls_made) AS BIGINT) AS calls, CAST(sum(errors_count) AS BIGINT) AS errors FROM processing_stats GROUP BY 1"
_by_day = lambda d: d.processing_stats.groupBy("date").agg(F.sum("articles_processed").alias("processed"), F.sum("api_calls_made").alias("calls"), F.sum("errors_count").alias("errors"))
plan("o109_last_days", f"SELECT * FROM ({_DAYS}) ORDER BY date DESC LIMIT 30")(lambda d: O.page(_by_day(d), [F.col("date").desc()], 30))
plan("o110_accumulated", _DAYS)(_by_day)
plan("o111_summary_categories", "SELECT category, count(*) AS n FROM daily_summaries GROUP BY 1")(lambda d: d.daily_summaries.groupBy("category").agg(F.count(F.lit(1)).alias("n")))
_L = "length(summary_text)"
plan("o112_digest_stats", f"SELECT date, count(*) AS n, CAST(sum({_L}) AS BIGINT) AS total, round(avg({_L}), 4) AS mean, CAST(max({_L}) AS BIGINT) AS longest, CAST(min({_L}) AS BIGINT) AS shortest FROM daily_summaries GROUP BY 1")(
    lambda d: d.daily_summaries.select("date", F.length("summary_text").cast("long").alias("l")).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("total"), F.round(F.avg("l"), 4).alias("mean"), F.max("l").alias("longest"), F.min("l").alias("shortest"))
)
plan("o113_digest_validation", "SELECT date, count(*) FILTER (length(trim(coalesce(summary_text, ''))) < 10) AS empty, count(*) FILTER (length(trim(coalesce(summary_text, ''))) BETWEEN 10 AND 19) AS short, count(*) FILTER (length(trim(summary_text)) >= 20) AS valid FROM daily_summaries GROUP BY 1")(
    lambda d: d.daily_summaries.select("date", F.length(F.trim(F.coalesce("summary_text", F.lit("")))).alias("l")).groupBy("date").agg(F.count_if(F.expr("l < 10")).alias("empty"), F.count_if(F.expr("l BETWEEN 10 AND 19")).alias("short"), F.count_if(F.expr("l >= 20")).alias("valid"))
)
_DSTATS = """SELECT domain, count(*) AS attempts, count(*) FILTER (success) AS successes, count(*) FILTER (success)::DOUBLE / count(*) AS r, avg(extraction_time_ms) AS t,
    coalesce(sum(content_length) FILTER (success AND content_length > 0), 0)::DOUBLE AS ls, max(created_at) FILTER (success) AS last_success, max(created_at) FILTER (NOT success) AS last_failure FROM attempts GROUP BY 1"""
_DOUT = f"""SELECT domain, attempts, successes, round(r, 4) AS rate, round(t, 4) AS mean_time, round(CASE WHEN successes > 0 THEN ls / successes ELSE 0 END, 4) AS mean_length,
    attempts >= 5 AND r >= 0.7 AS is_stable, r < 0.5 OR t > 5000 AS needs_optimization, last_success, last_failure FROM ({_DSTATS})"""
plan("o116_domain_stats", _DOUT)(lambda d: S.domain_stats(d.attempts))
plan("o206_domain_flags", f"SELECT domain, is_stable, needs_optimization FROM ({_DOUT})")(lambda d: S.domain_stats(d.attempts).select("domain", "is_stable", "needs_optimization"))
plan("o117_domain_summary", f"SELECT count(*) AS domains, count(*) FILTER (is_stable) AS stable, count(*) FILTER (needs_optimization) AS problematic, round(sum(successes)::DOUBLE / sum(attempts), 4) AS rate FROM ({_DOUT})")(
    lambda d: S.domain_stats(d.attempts).agg(F.count(F.lit(1)).alias("domains"), F.count_if("is_stable").alias("stable"), F.count_if("needs_optimization").alias("problematic"), F.round(F.sum("successes").cast("double") / F.sum("attempts"), 4).alias("rate"))
)
_MSTATS = "SELECT domain, strategy AS method, count(*) AS attempts, count(*) FILTER (success) AS successes, round(coalesce(avg(extraction_time_ms) FILTER (success), 0), 4) AS mean_time FROM attempts GROUP BY 1, 2"
plan("o116_method_stats", _MSTATS)(lambda d: S.method_stats(d.attempts))
plan("o122_best_method", f"SELECT domain, method, successes FROM ({_MSTATS}) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY successes::DOUBLE / attempts DESC, successes DESC, mean_time, method) = 1")(
    lambda d: R.best_methods(S.method_stats(d.attempts)).select("domain", "method", "successes")
)
plan("o207_ineffective_methods", f"SELECT domain, method FROM ({_MSTATS}) WHERE attempts >= 2 AND 1 - successes::DOUBLE / attempts >= CASE WHEN method = 'playwright' THEN 0.95 ELSE 0.8 END")(
    lambda d: S.method_stats(d.attempts).where("attempts >= 2 AND 1 - cast(successes AS double) / attempts >= CASE WHEN method = 'playwright' THEN 0.95D ELSE 0.8D END").select("domain", "method")
)
plan("o208_failed_methods", f"SELECT domain, method FROM ({_MSTATS}) WHERE attempts >= 2 AND successes = 0")(lambda d: S.method_stats(d.attempts).where("attempts >= 2 AND successes = 0").select("domain", "method"))
plan("o136_top_domains", f"SELECT domain, rate, attempts FROM ({_DOUT}) WHERE attempts >= 3 ORDER BY rate DESC, attempts DESC, domain LIMIT 10")(
    lambda d: O.page(S.domain_stats(d.attempts).where("attempts >= 3").select("domain", "rate", "attempts"), [F.col("rate").desc(), F.col("attempts").desc(), F.col("domain")], 10)
)
#: Sections of domains have few attempts each, so that some fail often.
_SECTION_SQL = _DOUT.replace("FROM attempts", "FROM (SELECT * REPLACE (concat(domain, '/', id % 197) AS domain) FROM attempts)")
plan("o136_problem_domains", f"SELECT domain, rate, attempts FROM ({_SECTION_SQL}) WHERE needs_optimization AND attempts >= 2 ORDER BY rate, attempts DESC, domain LIMIT 10")(
    lambda d: O.page(
        S.domain_stats(d.attempts.withColumn("domain", F.concat("domain", F.lit("/"), (F.col("id") % 197).cast("string")))).where("needs_optimization AND attempts >= 2").select("domain", "rate", "attempts"),
        [F.col("rate"), F.col("attempts").desc(), F.col("domain")], 10,
    )
)
plan("o137_most_active_domains", "SELECT domain, count(*) AS attempts FROM attempts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500")(lambda d: O.page(d.attempts.groupBy("domain").agg(F.count(F.lit(1)).alias("attempts")), [F.col("attempts").desc(), F.col("domain")], 500))
plan("o138_active_domains", f"SELECT domain FROM ({_DSTATS}) WHERE greatest(last_success, last_failure) >= {_TS} - INTERVAL 720 HOUR")(
    lambda d: S.domain_stats(d.attempts).where(F.greatest("last_success", "last_failure") >= O.instant(AS_OF) - F.expr("interval 30 days")).select("domain")
)
plan("o209_backoff", "SELECT domain, CASE WHEN failures = 0 THEN 0 ELSE round(least(600 * pow(1.5, least(failures, 8) - 1), 21600), 4) END AS delay_seconds FROM (SELECT domain, count(*) FILTER (NOT success) AS failures FROM attempts GROUP BY 1)")(
    lambda d: d.attempts.groupBy("domain").agg(F.count_if(~F.col("success")).alias("failures")).select("domain", F.when(F.col("failures") == 0, 0.0).otherwise(F.round(F.least(600 * F.pow(F.lit(1.5), F.least("failures", F.lit(8)) - 1), F.lit(21600.0)), 4)).alias("delay_seconds"))
)
plan(
    "o210_timeouts",
    f"SELECT domain, round(greatest(10.0, least(60.0, t * 1.5 / 1000 * CASE WHEN r >= 0.8 THEN 1.0 WHEN r >= 0.5 THEN 1.5 ELSE 2.0 END)), 4) AS seconds FROM ({_DSTATS})",
)(
    lambda d: S.domain_stats(d.attempts).join(d.attempts.groupBy("domain").agg(F.avg("extraction_time_ms").alias("t"), F.avg(F.col("success").cast("int")).alias("r")), "domain").select(
        "domain", F.round(F.greatest(F.lit(10.0), F.least(F.lit(60.0), F.col("t") * 1.5 / 1000 * F.when(F.col("r") >= 0.8, 1.0).when(F.col("r") >= 0.5, 1.5).otherwise(2.0))), 4).alias("seconds")
    )
)
_NEED = "CASE WHEN attempts < 3 THEN 'too few attempts' WHEN r < 0.5 THEN 'low success rate' WHEN t > 5000 THEN 'slow' ELSE 'fine' END"
plan("o211_optimization_reason", f"SELECT domain, {_NEED} AS reason FROM ({_DSTATS})")(
    lambda d: d.attempts.groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"), F.avg(F.col("success").cast("int")).alias("r"), F.avg("extraction_time_ms").alias("t")).select("domain", F.expr(_NEED).alias("reason"))
)
_PRIORITY = "CASE WHEN r = 0 THEN 'high' WHEN r < 0.5 THEN 'medium' ELSE 'low' END"
plan("o212_recommendations", f"SELECT domain, {_PRIORITY} AS priority FROM ({_DSTATS}) WHERE r < 0.9 AND attempts >= 3 OR r = 0")(
    lambda d: d.attempts.groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"), F.avg(F.col("success").cast("int")).alias("r")).where("r < 0.9 AND attempts >= 3 OR r = 0").select("domain", F.expr(_PRIORITY).alias("priority"))
)
plan("o302_dead_letters", "SELECT reason, count(*) AS n, count(*) FILTER (retry_count >= 3) AS exhausted, min(first_failed) AS oldest FROM dead_letters GROUP BY 1")(
    lambda d: d.dead_letters.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("retry_count") >= 3).alias("exhausted"), F.min("first_failed").alias("oldest"))
)
plan("o304_mappings_by_category", "SELECT fixed_category, count(*) AS n FROM category_mapping GROUP BY 1")(lambda d: d.category_mapping.groupBy("fixed_category").agg(F.count(F.lit(1)).alias("n")))
plan(
    "o305_first_headlines",
    "SELECT lang, count(*) AS n, string_agg(substring(title, 1, 60), ' / ' ORDER BY id) FILTER (k <= 2) AS headlines FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS k FROM articles) GROUP BY 1",
)(
    lambda d: d.articles.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(
        R.first_per(d.articles.select("lang", "id", "title"), ["lang"], [F.col("id")], 2).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("id", F.substring("title", 1, 60).alias("t")))).alias("x")), "lang"
    ).select("lang", "n", F.array_join("x.t", " / ").alias("headlines"))
)
plan("o306_last_thousand", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY 1")(
    lambda d: O.page(d.table("events").select("event_id", "ts", "event_type", "value"), [F.col("ts").desc(), F.col("event_id").desc()], 1000).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
)
plan("o307_usage_cost", "SELECT id, round((tokens_used * 0.15 + tokens_used * 0.6 + 0 * 0.075)::DOUBLE / 1e6, 4) AS cost FROM ai_usage")(
    lambda d: d.ai_usage.select("id", S.usage_cost(F.col("tokens_used"), F.col("tokens_used"), F.lit(0), (0.15, 0.6, 0.075)).cast("double").alias("cost"))
)
plan("o308_scheduler_status", "SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (is_running) AS running, min(next_run) FILTER (enabled) AS next FROM schedules")(
    lambda d: d.schedules.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"), F.count_if("is_running").alias("running"), F.min(F.when(F.col("enabled"), F.col("next_run"))).alias("next"))
)
plan("o279_lines_by_category", "SELECT category_id, string_agg(line, chr(10) ORDER BY article_id) AS lines FROM (SELECT b.category_id, b.article_id, concat('- ', a.title) AS line FROM article_categories b JOIN articles a ON b.article_id = a.id) GROUP BY 1")(
    lambda d: d.article_categories.select("category_id", "article_id").join(d.articles.select(F.col("id").alias("article_id"), F.concat(F.lit("- "), "title").alias("line")), "article_id")
    .groupBy("category_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("article_id", "line"))), lambda x: x["line"]), "\n").alias("lines"))
)
_BEST = "coalesce(b.confidence, 0.0)"
plan(
    "o120_best_category",
    f"""SELECT b.article_id, b.category_id FROM article_categories b JOIN articles a ON b.article_id = a.id WHERE a.is_advertisement <> true AND a.published_at >= timestamp '2024-01-10' AND a.published_at < timestamp '2024-01-11'
        QUALIFY row_number() OVER (PARTITION BY b.article_id ORDER BY {_BEST} DESC, b.category_id) = 1""",
)(
    lambda d: R.first_per(
        d.article_categories.join(
            d.articles.where(O.not_advertisement() & F.expr("published_at >= timestamp_ntz'2024-01-10' AND published_at < timestamp_ntz'2024-01-11'")).select(F.col("id").alias("article_id")), "article_id"
        ),
        ["article_id"], [F.coalesce("confidence", F.lit(0.0)).desc(), F.col("category_id")],
    ).select("article_id", "category_id")
)
plan("o121_per_source_cap", "SELECT id, source_id FROM articles QUALIFY row_number() OVER (PARTITION BY coalesce(source, 'unknown') ORDER BY published_at DESC, id) <= 10")(
    lambda d: R.first_per(d.articles.select("id", "source_id", "published_at", F.coalesce("source", F.lit("unknown")).alias("k")), ["k"], [F.col("published_at").desc(), F.col("id")], 10).select("id", "source_id")
)
_RATE = "CASE WHEN success_count + failure_count > 0 THEN success_count::DOUBLE / (success_count + failure_count) * 100 ELSE 0 END"
plan("o123_best_patterns", f"SELECT domain, id FROM patterns QUALIFY row_number() OVER (PARTITION BY domain ORDER BY {_RATE} DESC, consecutive_successes DESC, success_count DESC, id) <= 5")(lambda d: R.best_patterns(d.patterns).select("domain", "id"))
plan("o124_best_pattern", f"SELECT domain, id, round({_RATE}, 4) AS rate FROM patterns WHERE success_count > 0 AND {_RATE} > 50 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY {_RATE} DESC, success_count DESC, id) = 1")(
    lambda d: R.best_pattern(d.patterns).select("domain", "id", F.round("rate", 4).alias("rate"))
)
plan("o125_patterns_to_keep", f"SELECT domain, id FROM patterns QUALIFY row_number() OVER (PARTITION BY domain ORDER BY {_RATE} DESC, success_count DESC, consecutive_failures, id) <= 50")(lambda d: R.patterns_to_keep(d.patterns).select("domain", "id"))
plan("o126_page_structure", f"SELECT domain, role, id FROM (SELECT *, {_RATE} AS r, max({_RATE}) OVER (PARTITION BY domain, role) AS best FROM patterns) WHERE best < 50 OR r >= 50")(lambda d: R.page_structure(d.patterns).select("domain", "role", "id"))
_RUNS = """SELECT *, row_number() OVER (PARTITION BY domain, run ORDER BY created_at, id) AS run_length FROM (
    SELECT *, sum(changed) OVER (PARTITION BY domain ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, coalesce(CAST(success <> lag(success) OVER (PARTITION BY domain ORDER BY created_at, id) AS BIGINT), 1) AS changed FROM attempts))"""
plan(
    "o127_consecutive_counters",
    f"""SELECT domain, CASE WHEN success THEN run_length ELSE 0 END AS consecutive_successes, CASE WHEN success THEN 0 ELSE run_length END AS consecutive_failures, success AND run_length >= 3 AS is_stable
        FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) = 1""",
)(lambda d: R.last_runs(d.attempts, ["domain"], "success", ["created_at", "id"]))
plan("o128_failure_runs", f"SELECT id, domain, run_length FROM ({_RUNS}) WHERE NOT success")(lambda d: R.runs(d.attempts, ["domain"], "success", ["created_at", "id"]).where("NOT success").select("id", "domain", "run_length"))
plan(
    "o129_display_categories",
    """SELECT article_id, name, confidence FROM (SELECT b.article_id, m.fixed_category AS name, coalesce(b.confidence, 0.0) AS confidence FROM article_categories b JOIN category_mapping m ON lower(b.ai_category) = m.ai_category)
       QUALIFY row_number() OVER (PARTITION BY article_id, name ORDER BY confidence DESC) = 1""",
)(
    lambda d: d.article_categories.select("article_id", F.lower("ai_category").alias("k"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    .join(d.category_mapping.select(F.col("ai_category").alias("k"), F.col("fixed_category").alias("name")), "k").groupBy("article_id", "name").agg(F.max("c").alias("confidence"))
)
plan("o270_summaries", "SELECT id, date, category FROM daily_summaries WHERE date = '2024-01-10' ORDER BY date DESC, created_at DESC, id LIMIT 50")(
    lambda d: O.page(d.daily_summaries.where("date = '2024-01-10'").select("id", "date", "category", "created_at"), [F.col("date").desc(), F.col("created_at").desc(), F.col("id")], 50).drop("created_at")
)
plan("o272_summaries_by_date", "SELECT date, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS n FROM daily_summaries GROUP BY 1 ORDER BY 1 DESC")(
    lambda d: d.daily_summaries.groupBy("date").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"), F.count(F.lit(1)).alias("n")).orderBy(F.col("date").desc())
)
plan("o275_by_category", "SELECT a.id, a.fetched_at FROM articles a JOIN article_categories b ON a.id = b.article_id JOIN categories c ON b.category_id = c.id WHERE c.name = 'NATION_12' ORDER BY a.fetched_at DESC NULLS FIRST, a.id LIMIT 50")(
    lambda d: O.page(
        d.articles.select("id", "fetched_at").join(d.article_categories.join(d.categories.where("name = 'NATION_12'").select(F.col("id").alias("category_id")), "category_id").select(F.col("article_id").alias("id")), "id"),
        [F.col("fetched_at").desc_nulls_first(), F.col("id")], 50,
    )
)
plan("o276_mapping_list", "SELECT ai_category, fixed_category, usage_count FROM category_mapping WHERE is_active ORDER BY usage_count DESC, ai_category")(
    lambda d: d.category_mapping.where("is_active").orderBy(F.col("usage_count").desc(), "ai_category").select("ai_category", "fixed_category", "usage_count")
)
plan("o277_categories_by_confidence", "SELECT b.article_id, row_number() OVER (PARTITION BY b.article_id ORDER BY coalesce(b.confidence, 0.0) DESC, b.category_id) AS place, c.name FROM article_categories b JOIN categories c ON b.category_id = c.id")(
    lambda d: R.first_per(d.article_categories, ["article_id"], [F.coalesce("confidence", F.lit(0.0)).desc(), F.col("category_id")], 1 << 30, "place")
    .join(d.categories.select(F.col("id").alias("category_id"), "name"), "category_id").select("article_id", F.col("place").cast("long").alias("place"), "name")
)
plan("o278_by_date", "SELECT id, published_at FROM articles ORDER BY published_at DESC, id")(lambda d: d.articles.select("id", "published_at").orderBy(F.col("published_at").desc(), "id"))

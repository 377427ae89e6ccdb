"""Counts, rates and usage statistics. One aggregation a table, whatever the number of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feed import instant, since_hours


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole * scale, 0 where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * scale).otherwise(0.0)


def dashboard(articles: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """All article figures in one pass."""
    today = F.col("fetched_at") >= F.date_trunc("day", instant(as_of) - F.expr("interval 1 second")).cast("timestamp_ntz")
    df = articles.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(today).alias("today"), F.count_if(since_hours("fetched_at", as_of, 24 * days)).alias("last_days"),
        F.count_if("processed").alias("processed"), F.count_if(today & F.col("processed")).alias("processed_today"), F.count_if("is_advertisement").alias("advertisements"),
    )
    return df.withColumns(
        {
            "processed_rate": F.round(share(F.col("processed"), F.col("total")), 4),
            "advertisement_rate": F.round(share(F.col("advertisements"), F.col("total")), 4),
            "articles_per_hour": F.bround(F.col("today") / 24.0),
        }
    )


def usage(df: DataFrame, keys: list[Column] | None = None) -> DataFrame:
    """Calls, tokens, cost and patterns, in all or by keys."""
    figures = [F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"), F.coalesce(F.sum("patterns_discovered"), F.lit(0)).alias("patterns")]
    return df.groupBy(*keys).agg(*figures) if keys else df.agg(*figures)


def usage_window(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the last days, and those without an instant."""
    return df.where(since_hours("created_at", as_of, 24 * days) | F.col("created_at").isNull())


def extraction_figures(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"),
        F.round(F.count_if("success").cast("double") / F.count(F.lit(1)) * 100.0, 2).alias("success_rate"),
        F.round(F.avg("extraction_time_ms"), 5).alias("avg_time"), F.round(F.avg("quality_score"), 5).alias("avg_quality"), F.count_if("user_ai").alias("ai_count"),
    )


def domain_stats(attempts: DataFrame) -> DataFrame:
    """A domain's attempts as the running statistics end up: means of time over all attempts, of length over successes, stability flags."""
    ok = F.col("success")
    length = F.coalesce(F.sum(F.when(ok & (F.col("content_length") > 0), F.col("content_length"))), F.lit(0)).cast("double")
    df = attempts.groupBy("domain").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("successes"), F.avg("extraction_time_ms").alias("mean_time"), length.alias("length_sum"),
        F.max(F.when(ok, F.col("created_at"))).alias("last_success"), F.max(F.when(~ok, F.col("created_at"))).alias("last_failure"),
    )
    rate = F.col("successes").cast("double") / F.col("attempts")
    return df.select(
        "domain", "attempts", "successes", F.round(rate, 4).alias("rate"), F.round("mean_time", 4).alias("mean_time"),
        F.round(F.when(F.col("successes") > 0, F.col("length_sum") / F.col("successes")).otherwise(0.0), 4).alias("mean_length"),
        ((F.col("attempts") >= 5) & (rate >= 0.7)).alias("is_stable"), ((rate < 0.5) | (F.col("mean_time") > 5000)).alias("needs_optimization"), "last_success", "last_failure",
    )


def method_stats(attempts: DataFrame) -> DataFrame:
    """By domain and method; mean time over successes."""
    return attempts.groupBy("domain", F.col("strategy").alias("method")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), F.round(F.coalesce(F.avg(F.when(F.col("success"), F.col("extraction_time_ms"))), F.lit(0.0)), 4).alias("mean_time")
    )


def usage_cost(prompt: Column, completion: Column, cached: Column, rates: tuple[float, float, float]) -> Column:
    """Cost of a call at rates a million tokens, in ten-thousandths."""
    return F.round((prompt * rates[0] + completion * rates[1] + cached * rates[2]) / 1e6, 4).cast("decimal(10,4)")

"""First rows of groups, runs, and rankings; each over a stated total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.shared import before, join_skewed, settled


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_column: str | None = None) -> DataFrame:
    """The first n rows of each group; Spark keeps at most n rows a group before its shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= n)
    return ranked.withColumnRenamed("__rank", rank_column) if rank_column else ranked.drop("__rank")


def pattern_rate() -> Column:
    tried = F.col("success_count") + F.col("failure_count")
    return F.when(tried > 0, F.col("success_count").cast("double") / tried * 100.0).otherwise(0.0)


def best_methods(method_stats: DataFrame) -> DataFrame:
    """A domain's method by success rate, then successes, then speed."""
    order = [(F.col("successes").cast("double") / F.col("attempts")).desc(), F.col("successes").desc(), F.col("mean_time"), F.col("method")]
    return first_per(method_stats, ["domain"], order)


def best_patterns(patterns: DataFrame, most: int = 5, strategy: str | None = None) -> DataFrame:
    chosen = patterns.where(F.col("strategy") == strategy) if strategy else patterns
    return first_per(chosen.withColumn("rate", pattern_rate()), ["domain"], [F.col("rate").desc(), F.col("consecutive_successes").desc(), F.col("success_count").desc(), F.col("id")], most)


def best_pattern(patterns: DataFrame) -> DataFrame:
    rated = patterns.withColumn("rate", pattern_rate()).where("success_count > 0 AND rate > 50")
    return first_per(rated, ["domain"], [F.col("rate").desc(), F.col("success_count").desc(), F.col("id")])


def patterns_to_keep(patterns: DataFrame, most: int = 50) -> DataFrame:
    order = [pattern_rate().desc(), F.col("success_count").desc(), F.col("consecutive_failures"), F.col("id")]
    return first_per(patterns, ["domain"], order, most)


def page_structure(patterns: DataFrame, least: float = 50.0) -> DataFrame:
    """Of each domain and role the selectors with a good rate, or all where none has. Which have one is aggregated first, so a frequent domain is not gathered in one task."""
    keyed = patterns.withColumns({"rate": pattern_rate(), "__key": F.to_json(F.struct("domain", "role"))})
    good = settled(keyed.groupBy("__key").agg(F.max(F.col("rate") >= least).alias("any_good"), F.count(F.lit(1)).alias("__n")))
    total = good.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return join_skewed(keyed, good, ["__key"], "__n", total).where(~F.col("any_good") | (F.col("rate") >= least)).drop("__key", "__n")


def runs(events: DataFrame, keys: list[str], flag: str, order: list[str]) -> DataFrame:
    """Each row with the length of the run of equal flags that ends in it; a row whose flag is null is a run of its own.

    A row's run began after the last row before it with another flag. Both the rows' numbers and those last rows are found by ranges of the order, so a key may have any share of the rows.
    """
    numbered = before(events, order, groups=keys, name="__n")
    good, n = F.col(flag), F.col("__n")
    others = {"__not_good": F.when(~F.coalesce(good, F.lit(False)), n), "__not_bad": F.when(F.coalesce(good, F.lit(True)), n)}
    last = F.when(good.isNull(), n - 1).when(good, F.col("__not_good")).otherwise(F.col("__not_bad"))
    return before(numbered, ["__n"], others, keys, how="max").select(*events.columns, (n - F.coalesce(last, F.lit(-1))).cast("long").alias("run_length"))


def last_runs(events: DataFrame, keys: list[str], flag: str, order: list[str], stable_at: int = 3) -> DataFrame:
    """A key's consecutive successes and failures as they stand after its last row; a flag that is null counts as a failure.

    The last run is what comes after the last row with the other flag: two aggregations with partial sums, so a frequent key is not gathered in one task.
    """
    rows = events.select(*keys, F.to_json(F.struct(*keys)).alias("__key"), F.coalesce(F.col(flag), F.lit(False)).alias("__good"), F.struct(*order).alias("__at"))
    last = settled(
        rows.groupBy("__key").agg(F.max_by("__good", "__at").alias("__ends"), F.max(F.when(F.col("__good"), F.col("__at"))).alias("__up"), F.max(F.when(~F.col("__good"), F.col("__at"))).alias("__down"), F.count(F.lit(1)).alias("__n"))
        .select("__key", "__ends", F.when(F.col("__ends"), F.col("__down")).otherwise(F.col("__up")).alias("__other"), "__n")
    )
    total = last.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    in_last = F.count_if(F.col("__other").isNull() | (F.col("__at") > F.col("__other")))
    found = join_skewed(rows, last, ["__key"], "__n", total).groupBy(*keys, "__ends").agg(in_last.alias("__length"))
    zero = F.lit(0).cast("long")
    good, bad = F.when(F.col("__ends"), F.col("__length")).otherwise(zero), F.when(F.col("__ends"), zero).otherwise(F.col("__length"))
    return found.select(*keys, good.alias("consecutive_successes"), bad.alias("consecutive_failures"), (good >= stable_at).alias("is_stable"))

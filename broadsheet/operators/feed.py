"""Feed, search and listing operators over articles, categories and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def since_hours(column: str, as_of: str, hours: int) -> Column:
    """At or after `hours` before `as_of`; null instants drop out."""
    return F.col(column) >= instant(as_of) - F.expr(f"make_dt_interval(0, {int(hours)}, 0, 0)")


def not_advertisement(column: str = "is_advertisement") -> Column:
    """Three-valued: rows whose flag is unknown drop out too."""
    return F.col(column) != F.lit(True)


def with_category(articles: DataFrame, bridge: DataFrame, categories: DataFrame, name: str | None) -> DataFrame:
    """Articles in a category by name in any case; 'all' and null let every article through, 'advertisements' takes those."""
    if not name or name.lower() == "all":
        return articles
    if name.lower() == "advertisements":
        return articles.where(F.col("is_advertisement"))
    wanted = categories.where(F.lower("name") == name.lower()).select(F.col("id").alias("category_id"))
    return articles.join(bridge.join(wanted, "category_id").select(F.col("article_id").alias("id")), "id", "left_semi")


def in_categories(articles: DataFrame, bridge: DataFrame, categories: DataFrame, names: str) -> DataFrame:
    """Articles in any category of a comma-separated list."""
    listed = [n.strip().lower() for n in names.split(",") if n.strip()]
    wanted = categories.where(F.lower("name").isin(listed)).select(F.col("id").alias("category_id"))
    return articles.join(bridge.join(wanted, "category_id").select(F.col("article_id").alias("id")), "id", "left_semi")


def from_sources(articles: DataFrame, sources: DataFrame, listed: str) -> DataFrame:
    """Articles of a comma-separated list of sources: if any token is a number only the numbers count, else names."""
    tokens = [t.strip() for t in listed.split(",") if t.strip()]
    numbers = [int(t) for t in tokens if t.isdigit()]
    if numbers:
        return articles.where(F.col("source_id").isin(numbers))
    named = sources.where(F.col("name").isin(tokens)).select(F.col("id").alias("source_id"))
    return articles.join(named, "source_id", "left_semi")


def matches(query: str, columns: tuple[str, ...] = ("title", "summary", "content")) -> Column:
    """All tokens of two characters or more, each in any column in any case; % and _ are wildcards. No token: no condition."""
    condition = F.lit(True)
    for token in query.split():
        if len(token) >= 2:
            condition &= F.greatest(*[F.coalesce(F.col(c).ilike(f"%{token}%"), F.lit(False)) for c in columns])
    return condition


def relevance(query: str) -> Column:
    """3 for the whole phrase in the title, 2 in the summary, 1 otherwise."""
    phrase = f"%{query}%"
    return F.when(F.col("title").ilike(phrase), 3).when(F.col("summary").ilike(phrase), 2).otherwise(1)


def display_score(query: str) -> Column:
    """3 + 2 + 1 for the phrase in title, summary and content."""
    phrase = query.lower()
    return sum((F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(phrase)), n).otherwise(0) for c, n in (("title", 3), ("summary", 2), ("content", 1))), F.lit(0))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def clip(column: Column, most: int = 500, mark: str = "...") -> Column:
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit(mark))).otherwise(column)


def confidence_from_list(column: Column) -> Column:
    """The AI list's rule: missing and zero are 1."""
    return F.when(column.isNull() | (column == 0), F.lit(1.0)).otherwise(column)


def confidence_to_show(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def categories_of_page(articles: DataFrame, bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """Each article of a page with its categories as an array in order of confidence, then id."""
    named = bridge.join(categories.select(F.col("id").alias("category_id"), "name", "display_name"), "category_id")
    own = named.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    entry = F.struct((-confidence_to_show(F.col("confidence"))).alias("back"), "category_id", "name", "display_name")
    nested = own.groupBy("article_id").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    names = nested.select(F.col("article_id").alias("id"), F.array_join("c.name", ",").alias("category_names"), F.col("c")[0]["name"].alias("first_name"))
    return articles.join(names, "id", "left").withColumns({"category_names": F.coalesce("category_names", F.lit("")), "primary_category": F.coalesce("first_name", F.lit("Other"))}).drop("first_name")


def primary_category(bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """article_id, name of the category with most confidence (missing is 0), then smallest id."""
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "category_id"))
    best = bridge.select("article_id", "category_id", "confidence").withColumn("n", rank).where("n = 1")
    return best.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id").select("article_id", F.col("name").alias("primary_category"))


def category_counts(bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """Articles by category name in lower case, empty ones with 0; names that differ in case only count together. Counted before the join, so the bridge shuffles by category only."""
    counts = bridge.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    named = categories.join(counts, categories.id == counts.category_id, "left").select(F.lower("name").alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return named.groupBy("name").agg(F.sum("n").alias("articles"))


def source_counts(articles: DataFrame, sources: DataFrame, keep_empty: bool = False, enabled_only: bool = True) -> DataFrame:
    counts = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = sources.where("enabled") if enabled_only else sources
    joined = chosen.join(counts, chosen.id == counts.source_id, "left" if keep_empty else "inner")
    return joined.select("id", "name", "source_type", F.coalesce("n", F.lit(0).cast("long")).alias("articles"))


def unmapped(bridge: DataFrame, mapping: DataFrame) -> DataFrame:
    """Free-form labels without a mapping, with their numbers of articles."""
    labels = bridge.where(F.col("ai_category").isNotNull() & (F.col("ai_category") != "")).groupBy("ai_category").agg(F.count(F.lit(1)).alias("articles"))
    known = mapping.select(F.lower("ai_category").alias("k"))
    return labels.join(known, F.lower("ai_category") == F.col("k"), "left_anti")


def top_titles(labels: DataFrame, bridge: DataFrame, articles: DataFrame, most: int = 5) -> DataFrame:
    """For each label the first titles in alphabetical order, joined by ' | '."""
    titled = bridge.join(labels.select("ai_category"), "ai_category", "left_semi").join(articles.select(F.col("id").alias("article_id"), "title"), "article_id").select("ai_category", "title").distinct()
    rank = F.row_number().over(Window.partitionBy("ai_category").orderBy("title"))
    first = titled.withColumn("n", rank).where(F.col("n") <= most)
    joined = first.groupBy("ai_category").agg(F.array_join(F.sort_array(F.collect_list("title")), " | ").alias("examples"))
    return labels.join(joined, "ai_category", "left")

"""Digests: blocks of a day put together, packed into messages in order, and split texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.shared import before

LIMIT, FOOTER_ROOM = 3600, 80


def combined(summaries: DataFrame, least: int = 20) -> DataFrame:
    """One row a date: its valid summaries by articles, most first, under a header and above totals; and the length that decides on splitting."""
    valid = summaries.where(F.length(F.trim("summary_text")) >= least)
    block = F.struct((-F.col("articles_count")).alias("back"), "category", "id", F.trim("summary_text").alias("text"))
    days = valid.groupBy("date").agg(F.sort_array(F.collect_list(block)).alias("blocks"), F.sum("articles_count").alias("articles"), F.count(F.lit(1)).alias("categories"))
    header, footer = F.concat(F.lit("<b>"), "date", F.lit("</b>")), F.concat(F.lit("\n"), F.col("articles").cast("string"), F.lit(" / "), F.col("categories").cast("string"))
    body = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("<b>"), b["category"], F.lit("</b>\n"), b["text"], F.lit("\n"))), "\n")
    sizes = F.aggregate("blocks", F.lit(0), lambda a, b: a + F.length(b["category"]) + F.length(b["text"]))
    days = days.withColumns({"header": header, "footer": footer})
    return days.select("date", F.concat_ws("\n", "header", F.lit(""), body, "footer").alias("message"), (F.length("header") + sizes + F.length("footer")).cast("long").alias("chars"), "articles", "categories")


def split(summaries: DataFrame, limit: int = LIMIT, least: int = 20) -> DataFrame:
    """date, part, parts, message: blocks in order go into the current message while they and a footer fit; a block over the limit is a message of its own. A date's blocks are one category each."""
    valid = summaries.where(F.length(F.trim("summary_text")) >= least).select("date", "id", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("articles_count", F.lit(0)).alias("articles_count"), F.trim("summary_text").alias("text"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["articles_count", "category", "id"], ascending=[False, True, True])
        header = f"<b>{frame.date.iloc[0]}</b>"
        parts: list[list[str]] = []
        size = 0
        for row in frame.itertuples():
            room = len(row.category) + len(row.text) + 4
            if not parts or size + room + FOOTER_ROOM > limit and parts[-1]:
                parts.append([])
                size = len(header) + 2
            parts[-1].append(f"<b>{row.category}</b>\n{row.text}\n")
            size += room
        total = f"\n{int(frame.articles_count.sum())} / {len(frame)}"
        out = [(frame.date.iloc[0], i + 1, len(parts), "\n".join([header, "", *p, total if i + 1 == len(parts) else f"\n{i + 1}: {len(p)} / {len(frame)}"])) for i, p in enumerate(parts)]
        return pd.DataFrame(out, columns=["date", "part", "parts", "message"])

    return valid.groupBy("date").applyInPandas(fold, "date string, part int, parts int, message string")


def split_lines(texts: DataFrame, text: str, limit: int = LIMIT) -> DataFrame:
    """Each row's lines packed in order into parts of at most `limit` characters (a longer line is a part): columns but the text, part, piece."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, line):
        fits = F.length(acc["now"]) + F.length(line) + 1 <= limit
        closed = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(F.rtrim(F.regexp_replace(acc["now"], r"\s+$", "")))))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, F.concat(acc["now"], line, F.lit("\n"))).otherwise(F.concat(line, F.lit("\n"))).alias("now"))

    folded = F.aggregate(F.split(text, "\n"), start, step)
    every = F.when(F.length(text) <= limit, F.array(F.col(text))).otherwise(F.concat(folded["done"], F.array(F.regexp_replace(folded["now"], r"\s+$", ""))))
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(every).alias("part", "piece"))


def within_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each group in order while the running size is within the budget; null sizes count as 0. A group may have any share of the rows."""
    summed = before(rows, order, size, [group], "running").withColumn("running", F.col("running") + F.coalesce(size, F.lit(0)))
    return summed.where(F.col("running") <= budget)


def balanced_halves(counts: DataFrame, group: str, name: str, n: str) -> DataFrame:
    """Each group's names, most first, each into the half that is lighter so far; the first on ties."""
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.array().cast(f"array<struct<name:string,half:int>>").alias("out"))

    def step(acc, x):
        first = acc["a"] <= acc["b"]
        return F.struct(
            F.when(first, acc["a"] + x["n"]).otherwise(acc["a"]).alias("a"), F.when(first, acc["b"]).otherwise(acc["b"] + x["n"]).alias("b"),
            F.concat(acc["out"], F.array(F.struct(x["name"].alias("name"), F.when(first, 1).otherwise(2).alias("half")))).alias("out"),
        )

    entries = F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("back"), F.col(name).alias("name"), F.col(n).cast("long").alias("n"))))
    return counts.groupBy(group).agg(entries.alias("xs")).select(group, F.explode(F.aggregate("xs", start, step)["out"]).alias("r")).select(group, "r.name", "r.half")

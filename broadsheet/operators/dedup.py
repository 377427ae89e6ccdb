"""Deduplication, upserts, label mapping and snapshot differences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import strip
from broadsheet.shared import before, components, join_skewed, settled

#: Rows of a greedy pass that tasks fold by themselves at the end.
FOLDED = 100_000


def mark_copies(df: DataFrame, key: Column, order: list[str], ids: list[str]) -> DataFrame:
    """Rows with `is_copy`: an earlier row by order and ids has their key. Nulls are a key of their own; rows that are equal in order and ids are no copies of each other.

    The first row of each key is found by an aggregation, and frequent keys meet their rows by broadcast.
    """
    keyed, place = df.withColumn("__key", F.coalesce(key, F.lit(""))), F.struct(*dict.fromkeys([*order, *ids]))
    first = settled(keyed.groupBy("__key").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")))
    total = first.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return join_skewed(keyed, first, ["__key"], "__n", total).withColumn("is_copy", place != F.col("__first")).select(*df.columns, "is_copy")


def new_items(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Items whose hash an earlier snapshot does not have."""
    return now.join(before.select(key).distinct(), key, "left_anti")


def _json_string(text: Column) -> Column:
    """A JSON string in ASCII, other characters as \\uXXXX (two of them beyond the basic plane)."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        short = F.when(c == '"', '\\"').when(c == "\\", "\\\\").when(n == 8, "\\b").when(n == 9, "\\t").when(n == 10, "\\n").when(n == 12, "\\f").when(n == 13, "\\r")
        over = n - 0x10000
        return short.when((n < 32) | ((n > 126) & (n < 0x10000)), code(n)).when(n >= 0x10000, F.concat(code(F.lit(0xD800) + F.shiftright(over, 10)), code(F.lit(0xDC00) + over.bitwiseAND(0x3FF)))).otherwise(c)

    escaped = F.when(plain.rlike(r'[^ !#-\[\]-~]'), F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), 0), one), "")).otherwise(plain)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def item_hash(title: Column, link: Column, description: Column) -> Column:
    """MD5 of the item as JSON with sorted keys, in ASCII, with blanks after commas and colons; of the description the first 100 characters; missing fields are empty."""
    fields = (("description", F.substring(description, 1, 100)), ("link", link), ("title", title))
    parts = [x for i, (name, value) in enumerate(fields) for x in (F.lit(f'{", " if i else "{"}"{name}": '), _json_string(value))]
    return F.md5(F.concat(*parts, F.lit("}")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """The latest row of each key; new rows win ties with old ones, and of equally new ones the greatest as JSON. An aggregation with partial results, so a key may have any number of versions."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    place = F.struct(F.col(recency).alias("at"), F.col("__new").alias("new"), F.to_json(F.struct(*old.columns)).alias("text"))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), place).alias("__row")).select("__row.*")


def without_recent_titles(articles: DataFrame, hours: int = 168) -> DataFrame:
    """Articles (id, source_id, title, fetched_at) but those of which the same source has an article with a smaller id and the same title in any case that was not fetched more than `hours` before.

    The latest instant so far, in order of ids in each title of a source, is enough; it is found by ranges of the ids, so a title may have any share of the rows. Articles without a title or source stay and are not looked at.
    """
    titled = F.col("title").isNotNull() & F.col("source_id").isNotNull()
    low = articles.where(titled).withColumn("__low", F.lower("title"))
    seen = before(low, ["id"], "fetched_at", ["source_id", "__low"], "__before", "max")
    recent = F.col("__before") >= F.col("fetched_at") - F.expr(f"make_dt_interval(0, {int(hours)}, 0, 0)")
    return seen.where(~F.coalesce(recent, F.lit(False))).select(*articles.columns).unionByName(articles.where(~titled))


def merge_by_url(existing: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """Existing articles that incoming ones update: each incoming row meets the article with the smallest id of those whose URL is among its candidates. Articles that are summarised and processed stay as they are and do not
    come out; of the others every field takes the last incoming value that is not empty, else keeps its own. `existing`: id, url, summary, processed and the fields; `incoming`: seq, urls (candidates) and the fields."""
    each = incoming.select("seq", *[F.col(f).alias(f"__{f}") for f in fields], F.explode(F.array_distinct(F.filter("urls", lambda u: u.isNotNull() & (u != "")))).alias("url"))
    # The smallest article of each incoming row, by keys alone; then the fields. A URL has one article that matters, so frequent ones meet it by broadcast.
    smallest = existing.where("url IS NOT NULL").groupBy("url").agg(F.min("id").alias("id"))
    counted = settled(each.groupBy("url").agg(F.count(F.lit(1)).alias("__n")).join(smallest.hint("merge"), "url"))
    total = counted.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hit = join_skewed(each.select("seq", "url"), counted, ["url"], "__n", total).groupBy("seq").agg(F.min("id").alias("id"))
    given = incoming.select("seq", *[F.col(f).alias(f"__{f}") for f in fields]).join(hit, "seq")
    last = given.groupBy("id").agg(*[F.max_by(f"__{f}", F.when(F.col(f"__{f}").isNotNull() & (F.col(f"__{f}").cast("string") != ""), F.col("seq"))).alias(f"__{f}") for f in fields])
    open_ = existing.where(~F.coalesce(F.col("processed") & F.col("summary").isNotNull() & (F.col("summary") != ""), F.lit(False)))
    return open_.join(last, "id").select("id", *[F.coalesce(F.nullif(F.col(f"__{f}").cast("string"), F.lit("")).cast(existing.schema[f].dataType), F.col(f)).alias(f) for f in fields])


def list_page_fallback(items: DataFrame) -> DataFrame:
    """(page, is_fallback): whether a list page's items are one element of the whole page taken for an item: more than half of the links are missing or lead to the page itself, several items have one and the same link, or
    the only item has more than 5,000 characters. `items`: page, base (the page's address), link, description. Addresses are compared without query, fragment and closing slashes."""
    plain = lambda u: F.rtrim(F.regexp_replace(u, r"[?#].*$", ""), F.lit("/"))
    blank = F.col("link").isNull() | (F.col("link") == "")
    link = F.when(~blank, plain(F.col("link")))
    known = items.groupBy("page").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank | (link == plain(F.col("base")))).alias("at_base"), F.min(link).alias("least"), F.max(link).alias("most"), F.max(F.length("description")).alias("chars")
    )
    same = F.coalesce((F.col("least") == F.col("most")) & (F.col("n") > 1), F.lit(False))
    return known.select("page", ((F.col("at_base") > 0.5 * F.col("n")) | same | ((F.col("n") == 1) & (F.coalesce("chars", F.lit(0)) > 5000))).alias("is_fallback"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new rows whose keys are not among them."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def accumulate(old: DataFrame, new: DataFrame, key: str, sums: list[str]) -> DataFrame:
    return old.select(key, *sums).unionByName(new.select(key, *sums)).groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])


def remap(bridge: DataFrame, label: str, target: int) -> DataFrame:
    """Rows with the label move to the target category; of rows that then collide, one with the label stays."""
    hit = F.coalesce(F.lower("ai_category") == label.lower(), F.lit(False))
    moved = bridge.withColumns({"__hit": hit, "category_id": F.when(hit, F.lit(target)).otherwise(F.col("category_id"))})
    rank = F.row_number().over(Window.partitionBy("article_id", "category_id").orderBy(F.col("__hit").desc(), F.col("confidence").desc_nulls_last(), "ai_category"))
    return moved.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__hit")


def _substrings(text: str, lengths: list[int]) -> Column:
    """The distinct substrings of a text that have one of the lengths."""

    def of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(of, lengths))))


def _inside(inner: DataFrame, around: DataFrame) -> DataFrame:
    """(inner, around) pairs of distinct strings `s`, the one part of the other: equal substrings meet, so no string is compared with all others. Strings that are part of very many others meet them by broadcast."""
    lengths = sorted(r[0] for r in inner.select(F.length("s")).distinct().collect() if r[0])  # at most as many as the longest of them has characters
    if not lengths:
        return inner.select(F.col("s").alias("inner"), F.col("s").alias("around")).limit(0)
    parts = around.select(F.col("s").alias("around"), F.explode(_substrings("s", lengths)).alias("s"))
    counts = settled(parts.groupBy("s").agg(F.count(F.lit(1)).alias("__n")).join(inner, "s"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return join_skewed(parts, counts, ["s"], "__n", total).select(F.col("s").alias("inner"), "around")


#: What stands between the parts of a composite label; the first of these that a label has divides it.
SEPARATORS = ("|", "/", ",", " and ", " & ")


def backfilled(bridge: DataFrame, labelled: DataFrame, categories: DataFrame, other: str = "Other") -> DataFrame:
    """The bridge (article_id, category_id) after composite labels became categories: `labelled` (id, label) articles whose label has a separator lose the rows they had and get one for each part that is a category's name as it stands, or
    the one of `other` if there is none. Articles with other labels keep theirs. `categories`: id, name."""
    label, parts = F.col("label"), F.lit(None).cast("array<string>")
    for mark in reversed(SEPARATORS):
        parts = F.when(F.contains(label, F.lit(mark)), F.split(label, re.escape(mark))).otherwise(parts)
    composite = settled(labelled.select(F.col("id").alias("article_id"), parts.alias("parts")).where("parts IS NOT NULL"))
    named = composite.select("article_id", F.explode(F.array_distinct(F.transform("parts", lambda p: strip(p)))).alias("name"))
    found = settled(named.join(categories.select("name", F.col("id").alias("category_id")), "name").select("article_id", "category_id").distinct())
    rest = categories.where(F.col("name") == other).select(F.col("id").alias("category_id")).limit(1)  # one row
    none = composite.select("article_id").distinct().join(found.select("article_id").distinct(), "article_id", "left_anti").join(F.broadcast(rest))
    kept = bridge.select("article_id", "category_id").join(composite.select("article_id").distinct(), "article_id", "left_anti")
    return kept.unionByName(found).unionByName(none)


def first_by_part(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """Labels (with `__low`, not empty) with target and priority of every rule whose key is part of the label or has it as a part, each label's first rule among them."""
    keys = settled(rules.where("key <> ''").groupBy("key").agg(F.min(F.struct("priority", "target")).alias("r")))
    lows = settled(labels.select("__low").distinct())
    named, said = keys.select(F.col("key").alias("s")), lows.select(F.col("__low").alias("s"))
    pairs = _inside(named, said).select(F.col("inner").alias("key"), F.col("around").alias("__low")).unionByName(_inside(said, named).select(F.col("around").alias("key"), F.col("inner").alias("__low")))
    best = pairs.join(keys, "key").groupBy("__low").agg(F.min("r").alias("r")).select("__low", "r.target", "r.priority")
    empty = rules.where("key = ''").agg(F.min(F.struct("priority", "target")).alias("r")).where("r IS NOT NULL").select("r.target", "r.priority")  # one row: such a key is part of all
    return labels.join(best.unionByName(lows.join(F.broadcast(empty))), "__low").drop("__low")


def map_labels(labels: DataFrame, mapping: DataFrame, rules: DataFrame, valid: list[str], label: str = "label") -> DataFrame:
    """Each distinct label's category and where it came from: valid as it is, mapping exactly, mapping in lower case, rules exactly, rules by substring either way (first
    in the rules' order), else 'Other'. `mapping`: ai_category, fixed_category; `rules`: key, target, priority, any number of them."""
    low = F.lower(F.trim(F.col(label)))
    exact = mapping.groupBy(F.col("ai_category").alias("__a")).agg(F.min("fixed_category").alias("by_exact"))
    lower = mapping.groupBy(F.lower("ai_category").alias("__l")).agg(F.min("fixed_category").alias("by_lower"))
    rule = rules.select(F.col("key").alias("__k"), F.col("target").alias("by_rule"))
    distinct = labels.select(label).distinct().withColumn("__low", low)
    near = first_by_part(distinct.where("__low <> ''").select(F.col(label), "__low"), rules).groupBy(label).agg(F.min_by("target", "priority").alias("by_part"))
    found = (
        distinct.join(exact, F.col(label) == F.col("__a"), "left").join(lower, F.col("__low") == F.col("__l"), "left").join(rule, F.col("__low") == F.col("__k"), "left")
        .join(near.withColumnRenamed(label, "__n"), F.col(label) == F.col("__n"), "left")
    )
    blank = F.col(label).isNull() | (F.trim(label) == "")
    steps = [("valid", F.when(F.col(label).isin(valid), F.col(label))), ("exact", F.col("by_exact")), ("lower", F.col("by_lower")), ("rule", F.col("by_rule")), ("partial", F.col("by_part"))]
    source = F.when(blank, "fallback")
    for name, column in steps:
        source = source.when(column.isNotNull(), name)
    category = F.when(blank, F.lit("Other")).otherwise(F.coalesce(*[c for _, c in steps], F.lit("Other")))
    return found.select(label, category.alias("category"), source.otherwise("fallback").alias("mapping_source"))


def greedy_by_source(rows: DataFrame) -> DataFrame:
    """The rows that a greedy pass keeps: in order of `seq` within each source a row goes if any of its URLs or its title in lower case was
    kept before; rows that go mark nothing. `rows`: source_id, seq, id, title, urls (array).

    Rows that share no URL or title with another are kept as they are. Of rows with the same shared URLs and titles only the first can
    be kept, whatever happens before it; so frequent titles shrink to a few rows. The others are decided in rounds: a row that is the first of all its URLs and its title is kept, and those that share one with it go.
    So a group of any size is spread over tasks. When `FOLDED` rows are left, or a round decides less than a hundredth of them (long chains, each of whose rows waits for the one before), the rest is folded in
    order, each connected group by itself.
    """
    name = lambda mark, c: F.concat(F.lit(mark), F.col("source_id").cast("string"), F.lit(":"), c)
    each = F.concat(F.transform("urls", lambda u: name("u", u)), F.when(F.trim("title") != "", F.array(name("t", F.lower(F.trim("title"))))).otherwise(F.array().cast("array<string>")))
    keys = rows.select("seq", "id", F.explode(F.array_distinct(each)).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    clashing = settled(keys.join(shared, "key").groupBy("id", "seq").agg(F.sort_array(F.collect_list("key")).alias("keys")))
    left = settled(clashing.groupBy("keys").agg(F.min(F.struct("seq", "id")).alias("f")).select("f.*", "keys"))
    kept, n = [], left.count()
    while n > FOLDED:
        won, rest = _round(left)
        kept.append(won)
        left, n, was = rest, rest.count(), n
        if was - n < was / 100:
            break
    whole = rows.join(clashing.select("id"), "id", "left_anti").select("id")
    for found in [*kept, _folded(left)]:
        whole = whole.unionByName(found)
    return whole


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids of rows that come first at each of their keys, rows that share no key with these). `left`: id, seq, keys."""
    parts = left.select("id", "seq", F.explode("keys").alias("key"))
    first = settled(parts.groupBy("key").agg(F.min(F.struct("seq", "id")).alias("f"), F.count(F.lit(1)).alias("__n")))
    firsts = first.groupBy(F.col("f.id").alias("id")).agg(F.count(F.lit(1)).alias("first_at"))
    won = settled(left.join(firsts.hint("merge"), "id").where(F.col("first_at") == F.size("keys")).select("id", "keys"))
    taken = settled(won.select(F.explode("keys").alias("key")).join(first.select("key", "__n").hint("merge"), "key"))
    gone = join_skewed(parts.select("id", "key"), taken, ["key"], "__n", first.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]).select("id").distinct()
    return won.select("id"), settled(left.join(gone.hint("merge"), "id", "left_anti"))


def _folded(left: DataFrame) -> DataFrame:
    """Ids of the rows kept in order, each connected group of rows folded by one task."""
    parts = left.select("id", F.explode("keys").alias("key"))
    heads = parts.groupBy("key").agg(F.min("id").alias("b"))
    group = components(parts.join(heads, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()).withColumnRenamed("node", "id")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        kept = []
        for row in frame.sort_values(["seq", "id"]).itertuples():
            if not seen.intersection(row.keys):
                seen.update(row.keys)
                kept.append(row.id)
        return pd.DataFrame({"id": kept})

    grouped = left.join(group, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return grouped.groupBy("root").applyInPandas(fold, "id long")


def window_duplicates(rows: DataFrame, hours: int = 24) -> DataFrame:
    """Rows with `duplicate`: the same hash was kept less than `hours` before. `rows`: id, hash, at. Of the rows at a kept instant, the one with the smallest id is no duplicate. Rows without a hash or
    an instant are no duplicates and are not looked at.

    Each instant of a hash leads to the first one at least `hours` on; kept are those that its first instant leads to. The way is followed by doubling: in every round the known ones lead on by as many steps as there have been so far, and steps
    join to twice their length. So a hash with any number of instants takes a number of rounds that is the logarithm of the number of kept ones, and is never in one task.
    """
    span = F.expr(f"make_dt_interval(0, {int(hours)}, 0, 0)")
    first = settled(rows.where("hash IS NOT NULL AND at IS NOT NULL").groupBy("hash", "at").agg(F.min("id").alias("id")))
    several = first.groupBy("hash").agg(F.count(F.lit(1)).alias("instants"), F.min("at").alias("start")).where("instants > 1")
    # Instants and the ends of their times in one order: how many instants come before an end is the number of the instant that follows it.
    known = first.join(several.select("hash").hint("merge"), "hash", "left_semi").select("hash", "at")
    ends = known.select("hash", (F.col("at") + span).alias("t"), F.lit(0).alias("kind"), "at")
    counted = settled(before(known.select("hash", F.col("at").alias("t"), F.lit(1).alias("kind"), "at").unionByName(ends), ["t", "kind"], F.col("kind"), ["hash"], "n"))
    steps = settled(counted.groupBy("hash", "at").agg(F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("n"), F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("to")))
    places, total = steps.select("hash", "n", "at"), counted.groupBy("hash").agg(F.sum("kind").alias("__all"))
    step = settled(steps.join(total.hint("merge"), "hash").where(F.col("to") < F.col("__all")).select("hash", "n", "to"))
    reached = settled(places.where("n = 0").select("hash", "n"))
    while not step.isEmpty():
        on = reached.join(step.hint("merge"), ["hash", "n"]).select("hash", F.col("to").alias("n"))
        reached = settled(reached.unionByName(on))
        step = settled(step.join(step.select("hash", F.col("n").alias("to"), F.col("to").alias("further")).hint("merge"), ["hash", "to"]).select("hash", "n", F.col("further").alias("to")))
    kept = places.join(reached.hint("merge"), ["hash", "n"]).select("hash", "at")
    single = first.join(several.select("hash").hint("merge"), "hash", "left_anti").select("id")
    heads = first.join(kept.hint("merge"), ["hash", "at"], "left_semi").select("id").unionByName(single)
    timed = F.col("hash").isNotNull() & F.col("at").isNotNull()
    return rows.select("id", timed.alias("__timed")).join(heads.withColumn("__kept", F.lit(True)), "id", "left").select("id", (F.col("__timed") & F.col("__kept").isNull()).alias("duplicate"))

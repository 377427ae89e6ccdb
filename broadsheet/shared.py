"""What several operators need: results kept in the shared folder, joins with frequent keys, connected components, sums in an order."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder: the session's checkpoint folder. Where none is set, one of our own if driver and executors are one process; else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="broadsheet-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that every later read sees the same ones."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many tasks as there are cores, where few files would leave most of them idle; as they are where the files are many. For columns that take much time a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def join_skewed(rows: DataFrame, entries: DataFrame, keys: list[str], size: str, total: int, share: float = 1e-3) -> DataFrame:
    """Rows with the entry of their keys; `entries` has one row a key, with the number of `rows` that have it.

    Keys with more than `share` of all rows, at most 1 / share of them, are joined by broadcast and never shuffled.
    """
    most = max(1, int(total * share))
    heavy, light = entries.where(F.col(size) > most), entries.where(F.col(size) <= most)
    few = rows.join(F.broadcast(heavy), keys)
    many = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge"), keys)
    return few.unionByName(many)


def _least_around(edges: DataFrame, total: int, side: str, other: str) -> DataFrame:
    """`edges` with `least`, the least `other` of all edges that have the same `side`."""
    around = settled(edges.groupBy(side).agg(F.min(other).alias("least"), F.count(F.lit(1)).alias("n")))
    return join_skewed(edges, around, [side], "n", total)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected `edges` (a, b: long): the smallest node it is connected to. Null ends are left out.

    Large stars, then small stars, in turns: first every node hands its larger neighbours to the least node around it, then its smaller ones. Edges never become
    more, a path of n nodes in any order becomes a star in about log2(n) rounds, and rounds go on until nothing moves, so there is no bound on them. Each
    round is written to the shared folder. Nodes with very many neighbours are joined by broadcast, least neighbours are found by partial minima.
    """
    given = settled(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"))
    stars = settled(given.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        total = stars.count()
        # The least node around b is b itself, or the least of the smaller ends of edges whose larger end is b.
        below = settled(stars.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least")))
        degrees = stars.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        known = settled(degrees.join(below.hint("merge"), "b", "left").select("b", F.coalesce("least", "b").alias("least"), "n"))
        handed = settled(join_skewed(stars, known, ["b"], "n", total).select("a", F.col("least").alias("b")).distinct())
        small = settled(_least_around(handed, handed.count(), "a", "b"))
        moved = small.where("b <> least")
        if known.where("b <> least").isEmpty() and moved.isEmpty():
            break
        stars = settled(small.select("a", F.col("least").alias("b")).unionByName(moved.select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct())
    nodes = given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct()
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")).hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


#: Low bits of a row's number that count rows within their partition.
_PLACE = 33


def before(rows: DataFrame, order: list[Column | str], value: Column | str | dict[str, Column] | None = None, groups: list[str] | None = None, name: str = "before", how: str = "sum") -> DataFrame:
    """`rows` with the number of rows that come before each in `order`, or the sum (or with `how` the max) of `value` over them; with `groups`, among the rows of its group (nulls are one group). Several values have names of their own.

    Two levels, so that no group and not the whole is ever in one task: rows are dealt out in ranges of the order and written to the shared folder, each range is numbered or summed by itself,
    and what the ranges before it hold is added: one number a range, of which there are at most as many as the session has shuffle partitions, or one a range and group. Rows that are equal in `order`
    follow each other in any order, but in the same one however often the result is read. Sums take null values as 0, the max leaves them out.
    """
    keys, tie, row = [F.col(f"`{g}`") for g in groups or []], "__tie", "__row"
    by = [*keys, *[F.col(o) if isinstance(o, str) else o for o in order], F.col(tie)]
    dealt = rows.withColumn(tie, F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by).drop(tie)
    dealt = settled(dealt.withColumn(row, F.monotonically_increasing_id()))
    part, place = F.shiftright(row, _PLACE), F.col(row).bitwiseAND(F.lit((1 << _PLACE) - 1))
    if not keys and value is None:
        counts = dict(dealt.groupBy(part.alias("part")).count().collect())  # a row a range
        starts = np.cumsum([0, *[counts.get(p, 0) for p in range(max(counts, default=0))]]).tolist()
        return dealt.withColumn(name, F.get(F.lit(starts), part.cast("int")) + place).drop(row)
    values = value if isinstance(value, dict) else {name: F.lit(1) if value is None else F.col(value) if isinstance(value, str) else value}
    sums = how == "sum"
    added = {f"__added{i}": F.coalesce(v, F.lit(0)) if sums else v for i, v in enumerate(values.values())}
    together = F.sum if sums else F.max
    dealt = dealt.withColumns({"__part": part, "__place": place, **added}).drop(row)
    above = Window.partitionBy(*keys, "__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy(*keys, "__part").agg(*[together(a).alias(a) for a in added])
    over = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = held.select(*[k.alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__part").alias("__of"), *[together(a).over(over).alias(f"__earlier{i}") for i, a in enumerate(added)])
    on = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        on &= k.eqNullSafe(F.col(f"__key{i}"))
    joined = dealt.withColumns({f"__inside{i}": together(a).over(above) for i, a in enumerate(added)}).join(earlier.hint("merge"), on)
    total = lambda i: F.coalesce(F.col(f"__earlier{i}"), F.lit(0)) + F.coalesce(F.col(f"__inside{i}"), F.lit(0)) if sums else F.greatest(f"__earlier{i}", f"__inside{i}")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[total(i).alias(n) for i, n in enumerate(values)])

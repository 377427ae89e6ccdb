"""An index of character n-grams for substring search: which blocks of a table can match, so that only those are read.

A block is a range of ids and a folder of files. For every block the index lists the distinct runs of two and three characters of its
texts, in lower case as ILIKE compares them. A search looks up the runs of its tokens and reads the blocks that have all of them; the
condition itself is then applied to their rows, so that the index never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .feed import matches

#: Lengths of the listed runs: two for tokens that have no longer one.
SHORT, LONG = 2, 3
#: The block of rows without id; every search reads it.
NO_BLOCK = -1
#: Blocks that are named in a scan's partition filter; where more can match, they are joined.
NAMED = 10_000

_BLOCK = StructType().add("__block", "long")
_GRAM = StructType().add("gram", "string")


def _runs(text: Column, length: int) -> Column:
    """All overlapping runs of `length` characters, in time linear in the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def literal_runs(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards; a backslash takes the next character literally."""
    runs, escaped = [""], False
    for c in pattern:
        if not escaped and c == "\\":
            escaped = True
        elif not escaped and c in "%_":
            runs.append("")
        else:
            runs[-1] += c
            escaped = False
    return [r for r in runs if r]


def needed_grams(spark: SparkSession, query: str) -> set[str]:
    """Runs that a text must have to hold every token of two characters or more. Spark lowers the pattern, as it does for ILIKE."""
    tokens = [t for t in query.split() if len(t) >= 2]
    if not tokens:
        return set()
    lowered = spark.range(1).select(F.array(*[F.lower(F.lit(f"%{t}%")) for t in tokens])).first()[0]
    grams = set()
    for run in (r for pattern in lowered for r in literal_runs(pattern)):
        size = LONG if len(run) >= LONG else SHORT
        grams |= {run[i : i + size] for i in range(len(run) - size + 1)}
    return {g for g in grams if not any(0xD800 <= ord(c) <= 0xDFFF for c in g)}


@dataclass(frozen=True)
class SearchIndex:
    """Texts by block and the blocks' runs under one folder.

    Null texts have no run; rows with a null id are kept in a block that is always read; repeated rows stay; an empty table gives an index without
    blocks. Rows of the same columns may be added at any time (`add`); a block's runs only become more. `schema` is that of the rows, so that no footer is read to find it.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    span: int
    columns: tuple[str, ...]
    id: str

    @classmethod
    def build(cls, rows: DataFrame, folder: str, span: int = 1_000, columns: tuple[str, ...] = ("title", "summary", "content"), id: str = "id") -> SearchIndex:
        """An index of `rows` in a new folder, `span` ids a block. The fewer ids, the less is read beside what matches; the more, the fewer files."""
        index = cls(rows.sparkSession, folder.rstrip("/"), rows.schema, span, columns, id)
        index.add(rows)
        return index

    def add(self, rows: DataFrame) -> None:
        """Writes rows to their blocks; then lists their runs from what was written, so that both are of the same rows."""
        block = F.coalesce(F.floor(F.col(f"`{self.id}`") / self.span), F.lit(NO_BLOCK)).cast("long")
        part = f"{self.folder}/texts/__part={self._parts()}"
        rows.select(*[f"`{c}`" for c in self.schema.names]).withColumn("__block", block).repartition("__block").write.partitionBy("__block").parquet(part)
        written = self._read(part)
        own = []
        for c in self.columns:
            text = F.lower(F.coalesce(F.col(f"`{c}`"), F.lit("")))
            own += [_runs(text, SHORT), _runs(text, LONG)]
        grams = written.select("__block", F.explode(F.array_distinct(F.concat(*own))).alias("gram")).distinct()
        grams.repartitionByRange("gram", "__block").sortWithinPartitions("gram", "__block").write.mode("append").parquet(f"{self.folder}/grams")

    def _parts(self) -> int:
        """The number of additions so far."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/texts")
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return len(files.listStatus(path)) if files.exists(path) else 0

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, *_BLOCK])).parquet(path)

    def blocks(self, query: str) -> DataFrame | None:
        """__block of every block that has all runs of the query; None where it has no run to look up, so that any block can match."""
        grams = needed_grams(self.spark, query)
        if not grams:
            return None
        listed = self.spark.read.schema(StructType([*_BLOCK, *_GRAM])).parquet(f"{self.folder}/grams").where(F.col("gram").isin(sorted(grams)))
        return listed.groupBy("__block").agg(F.collect_set("gram").alias("found")).where(F.size("found") == len(grams)).select("__block")

    def search(self, query: str) -> DataFrame:
        """The rows that `matches(query)`, with their columns as they were added."""
        texts, blocks = self._read(f"{self.folder}/texts"), self.blocks(query)
        if blocks is not None:
            few = [r[0] for r in blocks.where(F.col("__block") != NO_BLOCK).limit(NAMED + 1).collect()]
            if len(few) <= NAMED:
                texts = texts.where(F.col("__block").isin([NO_BLOCK, *few]))
            else:
                every = blocks.unionByName(self.spark.range(1).select(F.lit(NO_BLOCK).cast("long").alias("__block"))).distinct()
                texts = texts.join(every, "__block", "left_semi")
        return texts.where(matches(query, self.columns)).drop("__block", "__part")

"""Exact deduplication with keyed streaming state.

Arriving documents are written to the state's folder: digest of the normalised text, id, length, content locator (number of the arrival and row in it) and the normalised
text. The narrow columns are a stream. A stateful aggregation keeps one entry a digest in RocksDB, on the executors' disks and
checkpointed to the shared folder, without expiry: how many texts have come, and the identifier and
locator of the one that stays. Later arrivals go through the same state, and their texts are compared with those of earlier ones.

Where a digest has several texts (a hit), their full bytes are compared: the least and the greatest text of the digest must be equal, else the texts under it are grouped by their bytes. Only
texts of hits move: a filter of at most 2^`FILTER_BITS` bits, of hashes of the digests that have several texts, is broadcast (at most 2^(`FILTER_BITS` - 6) numbers of 64 bits)
and drops nearly all others where they are read. Beyond some 10^8 hits it is full and texts of others move as well.

Digests with more than `HEAVY` of the rows, at most 1 / HEAVY of them, are joined by broadcast of their entries; the rest by shuffle. Only
DataFrame operations run on executors.

Texts are equal when identical after deleting every character of `[\\x20\\x09-\\x0D]`. Of equal texts, the one
with the most code points stays, then the smallest id (nulls last), then the
first to arrive. Ids are integers or what casts to them. Edge cases: a null text is an empty one, and empty and blank texts are equal; rows repeated
in full are copies, of which exactly one is kept; very long texts are compared whole; an empty table gives no rows; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._shared import settled, shared_path

#: Share of all rows above which a digest's rows are joined by broadcast.
HEAVY = 1e-3
_BLANKS = " \t\n\x0b\x0c\r"
#: Bits of the filter of digests that several texts have, at most.
FILTER_BITS = 27
_NARROW = "digest string, id long, points long, arrival long, row long"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class KeyedState:
    """One entry a digest, in a folder that outlives any one run."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.folder = folder or shared_path(spark, "dedup")
        self.session = spark.newSession()  # settings for the state store stay out of the caller's session
        for key, value in {
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside for each
            "spark.sql.streaming.metricsEnabled": "false",
            "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
        }.items():
            self.session.conf.set(key, value)

    def _exists(self, path: str) -> bool:
        at = self.session._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.session._jsc.hadoopConfiguration()).exists(at)

    def arrive(self, rows: DataFrame) -> None:
        """Adds rows (digest, id, points, norm) to the state. Each gets its locator: the arrival's number and its own in it, written with its text."""
        inbox = f"{self.folder}/inbox"
        arrival = 0
        if self._exists(inbox):
            arrival = self.session.read.schema(_NARROW).parquet(inbox).agg(F.coalesce(F.max("arrival") + 1, F.lit(0))).first()[0]
        kept = rows.select("digest", "id", "points", F.lit(arrival).cast("long").alias("arrival"), F.monotonically_increasing_id().alias("row"), "norm")
        kept.write.mode("append").parquet(inbox)
        stream = self.session.readStream.schema(_NARROW).parquet(inbox)
        # The greatest of: most code points, smallest id (nulls last), first arrival.
        stays = F.max(stays_by())
        entries = stream.groupBy("digest").agg(stays.alias("stays"), F.count(F.lit(1)).alias("size"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.select("digest", *kept_of("stays"), "size", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/entries/part_of={number}")

        query = (
            entries.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def entries(self, spark: SparkSession) -> DataFrame:
        """The last entry of each digest: digest, keep_id, keep_arrival, keep_row, size."""
        schema = "digest string, keep_id long, keep_arrival long, keep_row long, size long, batch long, part_of long"
        found = spark.read.schema(schema).parquet(f"{self.folder}/entries")
        last = F.max_by(F.struct("keep_id", "keep_arrival", "keep_row", "size"), "batch")
        return found.groupBy("digest").agg(last.alias("e")).select("digest", "e.*")

    def arrived(self, spark: SparkSession) -> DataFrame:
        """All rows of all arrivals, with their texts."""
        return spark.read.schema(f"{_NARROW}, norm string").parquet(f"{self.folder}/inbox")


def stays_by() -> Column:
    """The greatest of a digest's rows stays: most code points, smallest id (nulls last), first to arrive."""
    return F.struct("points", F.col("id").isNotNull().alias("known"), F.bitwise_not("id").alias("back"), F.bitwise_not("arrival").alias("later"), F.bitwise_not("row").alias("late"))


def kept_of(stays: str) -> list[Column]:
    return [F.bitwise_not(f"{stays}.{c}").alias(n) for c, n in (("back", "keep_id"), ("later", "keep_arrival"), ("late", "keep_row"))]


class HitFilter:
    """A bit for the hash of each digest that has several texts; no digest that has is missed."""

    def __init__(self, hits: DataFrame):
        self.bits = min(FILTER_BITS, max(10, (16 * hits.count()).bit_length()))
        self.words = settled(hits.select(self._hash().alias("h")).groupBy((F.shiftright("h", 6)).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("__bits")))

    def _hash(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(1 << self.bits))

    def marked(self, rows: DataFrame) -> DataFrame:
        """Rows (with a digest) with `__hit`: whether their digest may have several texts."""
        hashed = rows.withColumn("__h", self._hash()).withColumn("__word", F.shiftright("__h", 6))
        found = hashed.join(F.broadcast(self.words), "__word", "left")
        return found.withColumn("__hit", F.coalesce(F.expr("getbit(__bits, cast(__h & 63 as int))") == 1, F.lit(False))).drop("__h", "__word", "__bits")


def _keyed(rows: DataFrame, entries: DataFrame, heavy: DataFrame, light: DataFrame) -> DataFrame:
    """Rows with their digest's entry. `heavy` has at most 1 / HEAVY rows."""
    few = rows.join(F.broadcast(heavy), "digest")
    many = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light.hint("merge"), "digest")  # the same plan at every size
    return few.unionByName(many)


def _compared(df: DataFrame, text: str, id_column: str, state: KeyedState | None, digest: Callable[[Column], Column]) -> tuple[DataFrame, HitFilter]:
    """id, keep_id, keep_arrival, keep_row, size, arrival, row, digest of all rows that have arrived, and the filter of digests that have several."""
    spark = df.sparkSession
    state = state or KeyedState(spark)
    source = df.select(df[X.quoted(id_column)].cast("long").alias("id"), F.coalesce(df[X.quoted(text)].cast("string"), F.lit("")).alias("text"))
    with_norm = source.select("id", F.length("text").cast("long").alias("points"), normalised(F.col("text")).alias("norm"))
    state.arrive(with_norm.select(digest(F.col("norm")).alias("digest"), "id", "points", "norm"))
    arrived = state.arrived(spark)
    rows = arrived.drop("norm")
    entries = settled(state.entries(spark))
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    heavy = entries.where(F.col("size") > max(1, total * HEAVY))
    light = entries.where(F.col("size") <= max(1, total * HEAVY))

    # Full bytes of the hits: under one digest the least and the greatest text must be the same.
    hits = HitFilter(entries.where("size > 1"))
    span = hits.marked(arrived.select("digest", "norm")).where("__hit").groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    clash = settled(span.where("least <> most").select("digest"))

    out = _keyed(rows, entries, heavy, light)
    if not clash.isEmpty():
        # Different texts under one digest: group those by their bytes, in place of the state's entry.
        again = settled(arrived.join(clash, "digest", "left_semi"))
        by_bytes = again.groupBy("norm").agg(F.max(stays_by()).alias("b"), F.count(F.lit(1)).alias("size")).select("norm", *kept_of("b"), "size")
        out = out.join(clash, "digest", "left_anti").unionByName(again.join(by_bytes, "norm").drop("norm"))
    return out, hits


def _kept() -> Column:
    return (F.col("row") == F.col("keep_row")) & (F.col("arrival") == F.col("keep_arrival"))


def exact_duplicates(
    df: DataFrame, text: str = "text", id_column: str = "doc_id", state: KeyedState | None = None, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row a document: its id, keep_id, group_size, kept, text_sha256 (the digest). With a `state` that others have arrived in before, their rows, too: of all that have arrived, one of each group is kept."""
    out, _ = _compared(df, text, id_column, state, digest)
    return out.select(F.col("id").alias(id_column), "keep_id", F.col("size").alias("group_size"), _kept().alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that stay, with their columns. Only rows whose digest may have several texts move."""
    out, hits = _compared(df, text, id_column, None, sha256)
    ident = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("null"))
    stays = hits.marked(out.where(_kept()).select(ident(F.col("id")).alias("ident"), "digest")).where("__hit").select("ident", "digest")
    whole = F.coalesce(df[X.quoted(text)].cast("string"), F.lit(""))
    rows = df.select(F.struct(*[df[X.quoted(c)] for c in df.columns]).alias("row"), ident(df[X.quoted(id_column)]).alias("ident"), sha256(normalised(whole)).alias("digest"), whole.alias("whole"))
    marked = hits.marked(rows)
    one = marked.where("__hit").groupBy("ident", "digest").agg(F.max_by("row", F.struct(F.length("whole"), F.col("whole"))).alias("row"))
    kept = one.join(stays.hint("merge"), ["ident", "digest"]).select("row.*")
    return marked.where("NOT __hit").select("row.*").unionByName(kept)

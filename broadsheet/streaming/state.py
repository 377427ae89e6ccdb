"""Keyed streaming state: deduplication within a time, snapshot differences, running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from broadsheet.shared import shared_path


_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_folder(spark: SparkSession, name: str) -> str:
    """A folder for one query's state in the cluster's shared folder."""
    return shared_path(spark, name)


def run_available(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs over what has arrived and returns what was emitted, with `batch`, from files."""
    spark, out = stream.sparkSession, f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # state on disk, with timers
    try:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/n=*")


def _millis(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


class _Timed(StatefulProcessor):
    """State of a key with an end: one value, and one timer in event time at whose instant the value goes."""

    schema = "last string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.schema)

    def keep(self, value: tuple, until: pd.Timestamp) -> None:
        self.drop()
        self.value.update(value)
        self.handle.registerTimer(_millis(until))

    def drop(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.value.exists():
            self.value.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class _First(_Timed):
    def __init__(self, span: pd.Timedelta):
        self.span = span

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["at", "id"])
        last = pd.Timestamp(self.value.get()[0]) if self.value.exists() else None
        flags = []
        for at in rows["at"]:
            again = last is not None and at - last < self.span
            last = last if again else at
            flags.append(again)
        self.keep((last.isoformat(),), last + self.span)
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "hash": rows["hash"].to_numpy(), "at": rows["at"].to_numpy(), "duplicate": flags})


class _Locks(_Timed):
    schema = "failures long, last string"

    def __init__(self, threshold: int, lock: pd.Timedelta, forget: pd.Timedelta):
        self.threshold, self.lock, self.forget = threshold, lock, forget

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["at", "id"])
        failures, last = self.value.get() if self.value.exists() else (0, None)
        last, locked = pd.Timestamp(last) if last else None, []
        for at, success in zip(rows["at"], rows["success"], strict=True):
            full = failures >= self.threshold
            if failures and at >= last + (self.lock if full else self.forget):
                failures, full = 0, False
            locked.append(full)
            if not full:
                failures, last = (0, last) if success else (failures + 1, at)
        if failures:
            self.keep((failures, last.isoformat()), last + (self.lock if failures >= self.threshold else self.forget))
        else:
            self.drop()
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "address": rows["address"].to_numpy(), "at": rows["at"].to_numpy(), "locked": locked})


def _timed(stream: DataFrame, key: str, late: str, processor: _Timed, schema: str) -> DataFrame:
    timed = stream.withColumn("__time", F.to_timestamp(F.col("at"))).withWatermark("__time", late)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def first_within(stream: DataFrame, hours: int = 24, late: str = "7 days") -> DataFrame:
    """Rows (id, hash, at) with `duplicate`: their hash was kept less than `hours` before; time runs from the last kept one. A batch's rows of a hash are taken in order of time.

    The state of a hash goes when the watermark, `late` behind the latest instant, has passed the end of its time. Rows that come later than that are not looked at.
    """
    return _timed(stream, "hash", late, _First(pd.Timedelta(hours=hours)), "id long, hash string, at timestamp_ntz, duplicate boolean")


class _Snapshots(StatefulProcessor):
    """Of a page its last snapshot: instant and hashes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last, self.hashes = handle.getValueState("last", "snapshot string"), handle.getListState("hashes", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        known = {h for (h,) in self.hashes.get()} if self.hashes.exists() else set()
        fresh = []
        for at, items in rows[rows["snapshot"].notna()].groupby("snapshot", sort=True):
            if last is not None and at < last:
                continue
            items = items.drop_duplicates("hash")
            fresh.append(items[~items["hash"].isin(known)])
            known = set(items["hash"]) | (known if at == last else set())
            last = at
        if last is not None:
            self.last.update((last.isoformat(),))
            self.hashes.put([(h,) for h in known])
        for items in fresh:
            yield items[["page", "snapshot", "hash", "title"]]

    def close(self) -> None:
        pass


def new_on_page(stream: DataFrame) -> DataFrame:
    """Items (page, snapshot, hash, title) that the page's snapshot before did not have; an item that was gone and comes back is new again. `snapshot`: the instant at which the page was looked at.

    The state of a page is the hashes of its last snapshot, so it is bounded by the page. Items of that snapshot that come in a later batch go on with it; those of older ones are not looked at.
    """
    processor = _Snapshots()
    return stream.select("page", "snapshot", "hash", "title").groupBy("page").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType="page string, snapshot timestamp_ntz, hash string, title string", outputMode="Append", timeMode="None"
    )


def login_locks(stream: DataFrame, threshold: int = 5, seconds: int = 300, late: str = "7 days", forget: str = "30 days") -> DataFrame:
    """Attempts (id, address, at, success) with `locked`: the address had `threshold` failures without a success between them, and `seconds` have not gone by since the last of them. Attempts while locked do not count; after
    the time the count begins anew. Fewer failures are forgotten `forget` after the last of them.

    So every state has an end: a success, the end of the lock, or that of the failures' time; it goes when the watermark, `late` behind the latest instant, has passed it. Rows that come later than that are not looked at.
    """
    processor = _Locks(threshold, pd.Timedelta(seconds=seconds), pd.Timedelta(forget))
    return _timed(stream, "address", late, processor, "id long, address string, at timestamp_ntz, locked boolean")


def running_stats(stream: DataFrame) -> DataFrame:
    """Attempts, successes and mean time by domain, kept up to date."""
    return stream.groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), F.avg("extraction_time_ms").alias("mean_time"))


def late_windows(stream: DataFrame, time: str, delay: str, width: str) -> DataFrame:
    """Counts by tumbling window, emitted when the watermark has passed them."""
    instants = stream.withColumn(time, F.col(time).cast("timestamp"))
    return instants.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"))

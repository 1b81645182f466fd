"""Event-time streams with state: session windows that drop late rows, and visits kept by key with a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: State of processors with timers is kept in RocksDB; Spark's default store can't hold it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of the keys of visits; a store's state is kept by them, so they stay the same over restarts.
BUCKETS = 512


def stream_parquet(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Rows of Parquet files as they arrive, oldest file first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(path)


def sessions(events: DataFrame, at: str, gap: str, delay: str, *keys: str, value: str) -> DataFrame:
    """(keys, start, end, n, total): a key's rows of which each is `gap` after the one before at most. end is `gap` after the last.

    A session comes out once the watermark, which stays `delay` behind the latest row of earlier
    batches, has passed its end; its state is gone then. Rows whose own window the watermark has passed are dropped.
    Rows with a null time are dropped; null keys are a key of their own.
    """
    window = F.session_window(at, gap)
    grouped = events.where(F.col(at).isNotNull()).withWatermark(at, delay).groupBy(window.alias("window"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


class Visits(StatefulProcessor):
    """Numbers each key's rows over all batches and sums them up; a timer forgets keys that have been idle.

    Keys are dealt by hash into BUCKETS, and a bucket's keys are handled at once, so the calls of a batch
    don't grow with the keys. State of a bucket: its keys, and of each (rows, sum, latest time in microseconds) of the
    current visit; its timer is that of the first key that will be idle. A visit ends when the
    watermark has come `idle` seconds past its latest row; a later row begins a new visit at 1.
    """

    def __init__(self, idle: float, kind: str):
        self.idle, self.kind = idle, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visits = handle.getValueState("visits", f"keys array<{self.kind}>, rows array<long>, totals array<double>, latest array<long>")

    def _held(self) -> pd.DataFrame:
        keys, rows, totals, latest = self.visits.get() if self.visits.exists() else ([], [], [], [])
        return pd.DataFrame({"number": pd.array(list(rows), "int64"), "total": pd.array(list(totals), "float64"), "latest": pd.array(list(latest), "int64")}, index=pd.Index(list(keys)))

    def _ends(self, held: pd.DataFrame) -> pd.Series:
        return (held["latest"] // 1000 + self.idle * 1000).astype("int64")

    def _hold(self, held: pd.DataFrame) -> None:
        self.visits.update((held.index.tolist(), *(held[c].tolist() for c in ("number", "total", "latest"))))
        self.handle.registerTimer(int(self._ends(held).min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "unnamed", "id"], kind="stable", ignore_index=True)
        by_key = batch.groupby("key", sort=False)
        batch["number"] = batch["key"].map(held["number"]).fillna(0).astype("int64") + by_key.cumcount() + 1
        batch["total"] = batch["key"].map(held["total"]).fillna(0.0).astype("float64") + by_key["value"].cumsum()
        last = batch.drop_duplicates("key", keep="last").set_index("key")
        before = held["latest"].reindex(last.index).fillna(0).astype("int64")
        last["latest"] = last["at"].astype("datetime64[us]").astype("int64").combine(before, max)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        others = held[~held.index.isin(last.index)]
        self._hold(pd.concat([others, last[["number", "total", "latest"]]]) if len(others) else last)
        yield batch[["key", "id", "number", "total"]].assign(id=batch["id"].astype("Int64").mask(batch["unnamed"].astype(bool)), ended=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        over = self._ends(held) <= timerValues.getCurrentWatermarkInMs()
        if over.all():
            self.visits.clear()
        else:
            self._hold(held[~over])
        ended = held[over]
        yield pd.DataFrame({"key": ended.index, "id": pd.array([None] * len(ended), "Int64"), "number": ended["number"].to_numpy(), "total": ended["total"].to_numpy(), "ended": True})

    def close(self) -> None:
        pass


def visits(events: DataFrame, key: str, id_col: str, at: str, value: str, idle: float, delay: str) -> DataFrame:
    """(key, id, number, total, ended): each row with its number and the sum so far in its key's visit; and a row without id, with
    ended true, for each visit that is over.

    A batch's rows of a key are taken in the order of time and id. Rows later than the watermark are
    dropped. Rows with a null key or time are left out, null values count as 0, null ids come last. Only one batch of a
    bucket's rows is held by its task. The session's state store must be STATE_STORE.
    """
    rows = events.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(at).alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    rows = rows.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    kind = rows.schema["key"].dataType.simpleString()
    # ids without nulls stay whole numbers in pandas
    rows = rows.select("key", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("unnamed"), "at", "value", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(Visits(idle, kind), f"key {kind}, id long, number long, total double, ended boolean", "append", "eventTime")


def append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, each row once, also over restarts from the checkpoint; runs through what is there and stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

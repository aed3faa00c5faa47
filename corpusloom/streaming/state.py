"""ST3: the last values of each key as state with a time to live, and the same over a static table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The store that keeps state with timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastValues(StatefulProcessor):
    """The last ``n`` (ts, value) of a key by time, none older than ``ttl`` seconds before its newest; a timer at the end of the
    newest one's life drops the key's state, so keys that fall silent take no room."""

    def __init__(self, n: int, ttl: float):
        self.n, self.ttl = n, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "ts double, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
        for pdf in rows:  # never more than n are held beside a batch
            known = pdf[pdf["ts"].notna() & pdf["value"].notna()]
            kept = sorted([*kept, *zip(known["ts"].map(lambda t: t.timestamp()), known["value"].map(float), strict=True)])[-self.n :]
        kept = [x for x in kept if x[0] > kept[-1][0] - self.ttl]
        ends = int((kept[-1][0] + self.ttl) * 1000) if kept else 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept and ends > timerValues.getCurrentWatermarkInMs():
            self.kept.put(kept)
            self.handle.registerTimer(ends)
        elif self.kept.exists():
            self.kept.clear()
        yield pd.DataFrame({"key": [key[0]], "n": [len(kept)], "total": [round(sum(v for _, v in kept), 6)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame({"key": [key[0]], "n": [0], "total": [0.0]})

    def close(self) -> None:
        pass


def last_values(events: DataFrame, key: str, n: int = 10, ttl: float = 86_400.0, late: str = "10 minutes") -> DataFrame:
    """ST3: (key, n, total) over the last ``n`` values of each key of a stream (key, ts, value), updated with every micro-batch; 0 when
    the watermark has passed the end of the newest one's life. Rows without a time or value are left out."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(LastValues(n, ttl), outputStructType=f"key {kind}, n int, total double", outputMode="Update", timeMode="EventTime")


def last_values_of(events: DataFrame, key: str, n: int = 10, ttl: float = 86_400.0) -> DataFrame:
    """ST3 over a static table: (key, n, total) of the keys whose newest value is less than ``ttl`` seconds older than the table's newest.

    A key's rows that are too old go by its newest, an aggregate, before what is left is ordered.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).select(F.col(key).alias("key"), seconds.alias("at"), F.col("value").cast("double").alias("value"))
    newest = rows.groupBy("key").agg(F.max("at").alias("newest"))
    clock = newest.agg(F.max("newest").alias("now"))
    alive = newest.crossJoin(clock).where(F.col("newest") > F.col("now") - ttl * 1e6).select(F.col("key").alias("k"), "newest")
    near = rows.join(alive, F.col("key").eqNullSafe(F.col("k"))).where(F.col("at") > F.col("newest") - ttl * 1e6)
    w = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("value"))
    last = near.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return last.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.round(F.sum("value"), 6).alias("total"))

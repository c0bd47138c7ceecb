"""A cache with a time to live as a stream: a key goes stale when the event time passes its last fetch by that time.

State is one instant a key and one timer, which a newer fetch moves. When the watermark passes the timer, the key is
written as stale; until then readers compare its expiry with their own clock (`stale_at`), so that a key whose timer
hasn't fired yet isn't taken for fresh. Late and repeated fetches never shorten a life. A restarted stream goes on from
its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .jobs import drain, latest_of

OUT = "key string, state string, expires_ms long"


class Lives(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(int(frame["ms"].max()) for frame in rows) + self.ttl_ms
        held = self.expires.get()[0] if self.expires.exists() else None
        if held is not None and last <= held:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.expires.update((last,))
        if last > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last)
        yield pd.DataFrame({"key": [key[0]], "state": ["fetched"], "expires_ms": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [key[0]], "state": ["stale"], "expires_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def lives(fetches: DataFrame, ttl_seconds: int, path: str, lateness: str = "1 hour") -> DataFrame:
    """key, state (fetched or stale), expires_ms of a stream of fetches (key string, at timestamp)."""
    spark = fetches.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = fetches.where("key is not null and at is not null").withWatermark("at", lateness).select("key", "at", F.unix_millis("at").alias("ms"))
    out = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Lives(ttl_seconds * 1000), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
    return latest_of(drain(out, path, "update"), "key")


def stale_at(entries: DataFrame, now: Column) -> DataFrame:
    """The keys whose life has ended before an instant."""
    return entries.where((F.col("state") == "stale") | (F.col("expires_ms") < F.unix_millis(now))).select("key")

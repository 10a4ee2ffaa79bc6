"""A cache with a time to live as keyed streaming state: entries, expiry by event time, counts of hits and misses.

Each key is a state of its own, spread over the executors by key and kept in checkpoints, so a
restarted stream goes on with the entries it had. An entry that has expired is never a hit, whether or
not its timer has fired; timers only free the state once the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A lookup's result; hits and misses are those of the key so far, this lookup included.
LOOKUP = "cache_key string, seq long, at timestamp, hit boolean, value string, hits long, misses long"


class TtlCache(StatefulProcessor):
    """Per key: the last value set, until when it lives, and how many lookups found it or not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, expires_ms long")
        self.counts = handle.getValueState("counts", "hits long, misses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, expires = self.entry.get() if self.entry.exists() else (None, -1)
        hits, misses = self.counts.get() if self.counts.exists() else (0, 0)
        held, found = expires, []
        # rows come in no order; a set at the time of a lookup counts for it if its seq is smaller
        for r in pd.concat(list(rows)).sort_values(["at_ms", "seq"]).itertuples(index=False):
            if r.op == "set":
                value, expires = r.value, int(r.at_ms) + int(r.ttl_ms)
            elif r.op == "get":
                hit = value is not None and r.at_ms < expires
                hits, misses = hits + hit, misses + (not hit)
                found.append((key[0], r.seq, pd.Timestamp(r.at_ms, unit="ms"), bool(hit), value if hit else None, hits, misses))
        if value is not None:
            self.entry.update((value, expires))
            if expires != held:
                self.handle.registerTimer(expires)
        self.counts.update((hits, misses))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in LOOKUP.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())


def lookups(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The result (LOOKUP) of each lookup in a stream of cache operations.

    stream: cache_key, seq, at (timestamp), op (``set`` or ``get``), value, ttl_ms. An entry lives for
    ttl_ms after it was set; a null value counts as no entry. Rows of null key or time, and rows
    later than ``late`` behind the watermark, are left out. Within a micro-batch operations on a
    key apply by time, then seq; across micro-batches in the order they arrive. State is kept in
    RocksDB, which the session is set to.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = stream.where("cache_key IS NOT NULL AND at IS NOT NULL").select("cache_key", "seq", "at", "op", "value", "ttl_ms").withWatermark("at", late)
    rows = rows.withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("cache_key").transformWithStateInPandas(TtlCache(), LOOKUP, "Append", "EventTime")

"""Online timer pairing: one open start per timer name, kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class TimerPairs(StatefulProcessor):
    """A start replaces the open one; an end closes it, or is dropped when none is open.

    Rows of one name inside a micro-batch are ordered by (ts_us, seq) before they are applied.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start_us bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_us", "seq"], kind="stable")
        # The event before each row within this batch; before the first row it is whatever the state holds.
        after_start = batch["kind"].shift(1).eq("start").to_numpy(copy=True)
        start_us = batch["ts_us"].shift(1, fill_value=0).to_numpy(copy=True)
        if self.open.exists():
            after_start[0], start_us[0] = True, self.open.get()[0]
        done = batch["kind"].eq("end").to_numpy() & after_start
        if batch["kind"].iloc[-1] == "start":
            self.open.update((int(batch["ts_us"].iloc[-1]),))
        else:
            self.open.clear()
        if done.any():
            ends = batch[done]
            yield pd.DataFrame(
                {
                    "name": [key[0]] * len(ends),
                    "seq": ends["seq"].to_numpy(),
                    "start_us": start_us[done],
                    "end_us": ends["ts_us"].to_numpy(),
                    "duration_us": ends["ts_us"].to_numpy() - start_us[done],
                }
            )

    def close(self) -> None:
        pass


class EdgePairs(StatefulProcessor):
    """Pairs of slices that are over. Those inside a slice come as rows marked `paired`; the first event of a slice may close what the last event
    of the slice before left open. Memory holds one chunk of rows, and the first and last events of a name's slices in this micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        def pairs(ends, start_us):
            end_us = ends["ts_us"].to_numpy()
            return pd.DataFrame(
                {"name": [key[0]] * len(ends), "seq": ends["seq"].to_numpy(), "start_us": start_us, "end_us": end_us, "duration_us": end_us - start_us}
            )

        edges = []
        for chunk in rows:
            paired = chunk["paired"].to_numpy(dtype=bool)
            if paired.any():
                yield pairs(chunk[paired], chunk["start_us"].to_numpy()[paired])
            edges.append(chunk[(chunk["first"] | chunk["last"]).to_numpy(dtype=bool)])
        # Slices do not overlap, and the first event of a slice stands before its last.
        batch = pd.concat(edges).sort_values(["ts_us", "last"], kind="stable")
        starts, ts_us = batch["kind"].eq("start").to_numpy(), batch["ts_us"].to_numpy()
        before = self.open.get()
        after_start = np.concatenate([[before is not None], starts[:-1]])
        start_us = np.concatenate([np.array([before[0] if before else 0], dtype=np.int64), ts_us[:-1]])
        done = batch["first"].to_numpy(dtype=bool) & batch["kind"].eq("end").to_numpy() & after_start
        if starts[-1]:
            self.open.update((int(ts_us[-1]),))
        elif before is not None:
            self.open.clear()
        if done.any():
            yield pairs(batch[done], start_us[done])

    def close(self) -> None:
        pass


def _pairs_schema(events: DataFrame) -> T.StructType:
    longs = [T.StructField(name, T.LongType()) for name in ("seq", "start_us", "end_us", "duration_us")]
    return T.StructType([T.StructField("name", events.schema["name"].dataType), *longs])


def _in_slice(slices: DataFrame) -> DataFrame:
    """The rows of a slice that `EdgePairs` needs: its first and last event, and each end that follows a start inside it."""
    event, prior = F.col("event"), F.get("events", F.col("at") - 1)
    paired = F.coalesce((event["kind"] == "end") & (prior["kind"] == "start"), F.lit(False))
    first, last = F.col("at") == 0, F.col("at") == F.size("events") - 1
    rows = slices.select("name", "events", F.posexplode("events").alias("at", "event")).where(first | last | paired)
    return rows.select(
        "name", event["ts_us"].alias("ts_us"), event["seq"].alias("seq"), event["kind"].alias("kind"), first.alias("first"), last.alias("last"),
        paired.alias("paired"), F.when(paired, prior["ts_us"]).otherwise(0).alias("start_us"),
    )


def pair_timers_in_order(events: DataFrame, delay: str = "10 minutes", slice_ms: int = 1000) -> DataFrame:
    """Streaming form of timer pairing in the order of (ts_us, seq), for events that arrive in any order, up to `delay` late.

    Events wait in a windowed aggregate of one row per name and slice of time, until the watermark has passed the end of the slice; then only
    what crosses slices is paired by state of the name. So the last `delay` of a stream waits for later events. Events of slices that are
    over are dropped, and so are rows without a time. The session must use the RocksDB state store; see `use_rocksdb`.
    """
    ts_us = F.col("ts_us").cast("bigint")
    timed = events.select("name", "kind", ts_us.alias("ts_us"), F.col("seq").cast("bigint").alias("seq"), F.timestamp_micros(ts_us).alias("at"))
    slices = (
        timed.where(F.col("ts_us").isNotNull())
        .withWatermark("at", delay)
        .groupBy("name", F.window("at", f"{slice_ms} milliseconds"))
        .agg(F.sort_array(F.collect_list(F.struct("ts_us", "seq", "kind"))).alias("events"))
    )
    return _in_slice(slices).groupBy("name").transformWithStateInPandas(EdgePairs(), _pairs_schema(events), outputMode="Append", timeMode="None")


def pair_timers_online(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of timer pairing. The session must use the RocksDB state store; see `use_rocksdb`.

    `ttl_ms` drops starts that never end. It puts the operator in processing-time mode, in which Spark schedules empty
    batches for as long as the query runs: use it with a periodic trigger, since an `availableNow` run would not finish.
    """
    return (
        events.select("name", "kind", F.col("ts_us").cast("bigint"), F.col("seq").cast("bigint"))
        .groupBy("name")
        .transformWithStateInPandas(
            TimerPairs(ttl_ms), _pairs_schema(events), outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
        )
    )


def use_rocksdb(spark) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)

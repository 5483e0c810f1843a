"""Bars from a stream of ticks, and hysteresis whose state lives between micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.regimes import HARD, PERSIST, SOFT, check, step


def tick_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def bars(ticks: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars of (ts, event_id, value) ticks; bars close when the watermark passes them.  The same
    code runs over a table, where the watermark means nothing."""
    own = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if own.isStreaming else own
    key = F.struct("ts", "event_id")
    out = own.groupBy(F.window("ts", every)).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select(F.lit("ALL").alias("ticker"), F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stateful_hysteresis(posteriors: DataFrame, hard: float = HARD, soft: float = SOFT, persist: int = PERSIST) -> DataFrame:
    """(ticker, ts, held) from a stream of (ticker, ts, p); a ticker's state is (held, pending, count)."""
    check(hard, soft, persist)

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, pending, count = state.get if state.exists else (None, None, 0)
        frame = pd.concat(list(frames)).sort_values("ts")  # a key's rows of one micro-batch
        out = []
        for p in frame["p"]:
            held, pending, count = step(held, pending, count, p, hard, soft, persist)
            out.append(held)
        state.update((held, pending, count))
        yield pd.DataFrame({"ticker": key[0], "ts": frame["ts"], "held": pd.Series(out, index=frame.index, dtype="int32")})

    ts = posteriors.schema["ts"].dataType.simpleString()
    return posteriors.groupBy("ticker").applyInPandasWithState(update, f"ticker string, ts {ts}, held int", "held int, pending int, count int", "append", GroupStateTimeout.NoTimeout)


class Trigger(StatefulProcessor):
    """The trigger of one ticker: (held, pending, count) as a value state.

    A row without posteriors resets it: what follows is a new series.  It is given up ``keep`` milliseconds after its
    last change (the store's own expiry), and by a timer when a ticker had no rows for ``idle`` milliseconds."""

    def __init__(self, hard: float, soft: float, persist: int, keep: int | None = None, idle: int | None = None):
        check(hard, soft, persist)
        self.setting, self.keep, self.idle = (hard, soft, persist), keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trigger", "held int, pending int, count int", self.keep)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for held, pending, count in initialState[["held", "pending", "count"]].itertuples(index=False):
            self.state.update((int(held), None if pd.isna(pending) else int(pending), int(count)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = (self.state.get() if self.state.exists() else None) or (None, None, 0)
        frame = pd.concat(list(rows))  # a ticker's rows of one micro-batch
        order = sorted(range(len(frame)), key=lambda i: (frame["ts"].iloc[i], frame["p"].iloc[i] is not None))
        ts, held = [], []
        for i in order:
            p = frame["p"].iloc[i]
            if p is None:
                state = (None, None, 0)
                continue
            state = step(*state, p, *self.setting)
            ts.append(frame["ts"].iloc[i])
            held.append(state[0])
        if state[0] is None:
            self.state.clear()
        else:
            self.state.update(state)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame({"ticker": [key[0]] * len(ts), "ts": pd.Series(ts, dtype=frame["ts"].dtype), "held": pd.Series(held, dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def trigger_stream(posteriors: DataFrame, hard: float = HARD, soft: float = SOFT, persist: int = PERSIST, known: DataFrame | None = None, keep: int | None = None, idle: int | None = None) -> DataFrame:
    """(ticker, ts, held) from a stream of (ticker, ts, p), a null ``p`` starting a new series from that ts on; ``known``:
    (ticker, held, pending, count), the states to start from, as a table.  Runs under ``rocks``."""
    ts = posteriors.schema["ts"].dataType.simpleString()
    start = known.groupBy("ticker") if known is not None else None
    return posteriors.select("ticker", "ts", "p").groupBy("ticker").transformWithStateInPandas(Trigger(hard, soft, persist, keep, idle), f"ticker string, ts {ts}, held int", "append", "processingTime", start)


#: Timers and expiry need this state store.  Under processing time Spark plans batches without data for ever, which a
#: query that ends with its input must not have: timers then fire in the batches that have data.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def rocks(spark: SparkSession):
    """Settings for ``trigger_stream`` queries that are started inside and end with their input; restored afterwards."""
    before = {k: spark.conf.get(k) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def refit_each_batch(stream: DataFrame, fit: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands every micro-batch to ``fit`` (a model refresh); ends when the input is read."""
    return stream.writeStream.foreachBatch(fit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Reads what is there, writes it to Parquet, and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()

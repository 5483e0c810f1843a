"""The trigger as an Arrow table function, for SQL: ``trigger_counts(TABLE(…) PARTITION BY … ORDER BY ts)``.

A partition is one series under one lot of settings; its rows come in batches, of which only the machine's states (one a
setting) and the counts go on, so memory is bounded by a batch.  All settings of a lot advance side by side.  Lots of one
series are different tasks; a series that is too long for a task is for ``trigger.flip_counts``, which cuts it in blocks.

Rows: (ticker, ts, p, settings), ``settings`` the same in a partition; a null ``p`` counts as zeros; posteriors longer than
those of the first batch are an error; a partition without settings, and an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udtf

from .trigger import Machine, _arrays

NAME = "trigger_counts"
COUNTS = "ticker string, hard double, soft double, persist int, n bigint, raw_flips bigint, held_flips bigint, same bigint"


@arrow_udtf(returnType=COUNTS)
class TriggerCounts:
    def __init__(self):
        self.machine, self.ticker, self.n, self.raw_flips, self.last = None, None, 0, 0, None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if not len(rows):
            return
        if self.machine is None:
            self.ticker, settings = rows.column("ticker")[0].as_py(), rows.column("settings")[0].as_py() or []
            if not settings:
                return
            labels = max((len(x) for x in rows.column("p").to_pylist() if x), default=1)
            self.machine = Machine(labels, [(x["hard"], x["soft"], x["persist"]) for x in settings])
            self.state = np.zeros((1, len(settings), 1), np.int64)
            self.held_flips, self.same = np.zeros(len(settings), np.int64), np.zeros(len(settings), np.int64)
        bars = rows.column("p")
        widest = max((len(x) for x in bars.to_pylist() if x), default=0)
        if widest > self.machine.labels:
            raise ValueError(f"posteriors of {widest} labels after {self.machine.labels}")
        one = pa.ListArray.from_arrays(pa.array([0, len(bars)], pa.int32()), bars)
        p, length = _arrays(pa.RecordBatch.from_arrays([one], ["p"]), self.machine.labels, len(bars))
        raw = p[0].argmax(axis=1)
        before = self.machine.held[self.state[0, :, 0]]
        for t, _, state in self.machine.walk(p, length, self.state):
            held = self.machine.held[state[0, :, 0]]
            self.held_flips += (before >= 0) & (held != before)
            self.same += held == raw[t]
            before, self.state = held, state
        self.raw_flips += int((raw[1:] != raw[:-1]).sum()) + int(self.last is not None and self.last != raw[0])
        self.n, self.last = self.n + len(raw), raw[-1]
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if self.machine is not None:
            k = len(self.machine.settings)
            hard, soft, persist = zip(*self.machine.settings)
            columns = [[self.ticker] * k, hard, soft, persist, [self.n] * k, [self.raw_flips] * k, self.held_flips, self.same]
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), *([pa.int64()] * 4)]
            yield pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["ticker", "hard", "soft", "persist", "n", "raw_flips", "held_flips", "same"])


def register(spark: SparkSession, name: str = NAME) -> None:
    """Makes the table function known to the session's SQL."""
    spark.udtf.register(name, TriggerCounts)


def lots(hard: list[float], soft: list[float], persist: list[int]):
    """The grid as an array of lots, one to each hard threshold: (hard, settings), settings with hard >= soft."""
    of = lambda h: F.array(*(F.struct(F.lit(h).alias("hard"), F.lit(s).alias("soft"), F.lit(t).cast("int").alias("persist")) for s in soft for t in persist))
    every = F.array(*(F.struct(F.lit(h).alias("hard"), F.filter(of(h), lambda x: x["hard"] >= x["soft"]).alias("settings")) for h in hard))
    return F.filter(every, lambda x: F.size(x["settings"]) > 0)


def dealt(df: DataFrame, hard: list[float], soft: list[float], persist: list[int]) -> DataFrame:
    """(ticker, ts, p, hard, settings): every row of the posteriors once for each lot of the grid."""
    return df.select("ticker", "ts", "p", F.explode(lots(hard, soft, persist)).alias("lot")).select("ticker", "ts", "p", "lot.hard", "lot.settings")


def counts(df: DataFrame, hard: list[float], soft: list[float], persist: list[int]) -> DataFrame:
    """``COUNTS`` of every setting of the grid on every series of posteriors (ticker, ts, p); a lot of a series is a task's work."""
    return TriggerCounts(dealt(df, hard, soft, persist).asTable().partitionBy("ticker", "hard").orderBy("ts"))

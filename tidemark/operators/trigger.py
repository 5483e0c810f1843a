"""The hysteresis trigger over long series: transition maps of blocks, composed and scanned.

The trigger is a finite machine: its state is (held label, pending label, count), of which there are
1 + L (1 + L (persist - 1)) for L labels, the empty one included.  A block of bars maps each state at its start
to one at its end.  1. Every block's map is computed by itself, all states and settings side by side.  2. Maps
are composed along each ticker in groups of ``FAN``, groups of groups and so on, which gives every block the
state it starts from.  3. Every block is walked once from there.  A long series is thus many tasks, and nothing
passes through one but ``FAN`` maps.

Rows: posteriors ``p`` have one length in all rows (a shorter one counts as 0 beyond its end); ``(ticker, ts)``
tells rows apart; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.blocks import numbered
from ..functions.shared import written

#: Bars of a block; maps that are composed in one task; lanes (blocks, settings, states) that run side by side.
SIZE, FAN, LANES = 256, 512, 1 << 20


class Machine:
    """All states of the trigger for ``labels`` labels under several settings (hard, soft, persist)."""

    def __init__(self, labels: int, settings: list[tuple[float, float, int]]):
        self.labels, self.settings, self.deep = labels, settings, max(t for _, _, t in settings)
        self.width = 1 + labels * (self.deep - 1)
        self.states = 1 + labels * self.width
        code = np.arange(self.states)
        rest = (code - 1) % self.width - 1
        self.held = np.where(code == 0, -1, (code - 1) // self.width)
        self.pending = np.where((code == 0) | (rest < 0), -1, rest // max(1, self.deep - 1))
        self.count = np.where(self.pending < 0, 0, rest % max(1, self.deep - 1) + 1)
        self.hard, self.soft, self.persist = (np.array(x)[None, :, None] for x in zip(*settings))

    def advance(self, state: np.ndarray, p: np.ndarray, top: np.ndarray) -> np.ndarray:
        """States (block, setting, lane) after a bar with posteriors p (block, label) and their first greatest label."""
        held, pending, first = self.held[state], self.pending[state], top[:, None, None]
        own = np.take_along_axis(p, np.maximum(held, 0).reshape(len(p), -1), axis=1).reshape(held.shape)
        margin = p[np.arange(len(p)), top][:, None, None] - own
        count = np.where(pending == first, self.count[state] + 1, 1)
        stay, turn = 1 + held * self.width, np.broadcast_to(1 + first * self.width, state.shape)
        waits = stay + 1 + first * (self.deep - 1) + count - 1
        new = np.where(margin >= self.hard, turn, np.where(margin < self.soft, stay, np.where(count >= self.persist, turn, waits)))
        return np.where(held < 0, turn, np.where(held == first, stay, new))

    def walk(self, p: np.ndarray, length: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bar, which blocks have it, states after it) of blocks p (block, bar, label) from ``state``."""
        for t in range(p.shape[1]):
            live = length > t
            state = np.where(live[:, None, None], self.advance(state, p[:, t], p[:, t].argmax(axis=1)), state)
            yield t, live, state


def cut(df: DataFrame, size: int = SIZE) -> tuple[DataFrame, int, int]:
    """(blocks, labels, blocks of the longest series): (ticker, block, ts, p), bars in order, a block a row, written."""
    own = numbered(df.select("ticker", "ts", "p"))
    rows = own.groupBy("ticker", F.floor(F.col("at") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "ts", "p"))).alias("bars"))
    table = written(rows.select("ticker", "block", F.col("bars.ts").alias("ts"), F.col("bars.p").alias("p")), "blocks")
    found = table.agg(F.max("block"), F.max(F.array_max(F.transform("p", lambda x: F.size(x))))).first()
    return table, found[1] or 1, (found[0] or 0) + 1


def _arrays(batch: pa.RecordBatch, labels: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(p as block, bar, label; bars of each block) of a batch of blocks."""
    bars = batch.column("p")
    each = bars.flatten()
    length = np.diff(bars.offsets.to_numpy()).astype(np.int64)
    wide = np.diff(each.offsets.to_numpy())
    flat = np.zeros((len(each), labels))
    flat[np.repeat(np.arange(len(each)), wide), np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)] = each.flatten().to_numpy(zero_copy_only=False)
    p = np.zeros((len(bars), max(size, int(length.max(initial=0))), labels))
    p[np.repeat(np.arange(len(bars)), length), np.arange(len(each)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return p, length


def _lots(batches, each: int):
    """Slices of the batches with at most ``LANES`` lanes, ``each`` to a block."""
    step = max(1, LANES // each)
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def maps(blocks: DataFrame, machine: Machine, size: int = SIZE) -> DataFrame:
    """(ticker, setting, block, map): the state at the end of each block for each state at its start."""

    def work(batches):
        n, m = len(machine.settings), machine.states
        for batch in _lots(batches, n * m):
            p, length = _arrays(batch, machine.labels, size)
            state = np.broadcast_to(np.arange(m), (len(p), n, m))
            for _, _, state in machine.walk(p, length, state):
                pass
            row = pa.array(np.repeat(np.arange(len(p)), n))
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * n * m + 1, m, dtype=np.int32)), pa.array(state.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("ticker").take(row), pa.array(np.tile(np.arange(n, dtype=np.int32), len(p))), batch.column("block").take(row), out], ["ticker", "setting", "block", "map"])

    return blocks.select("ticker", "block", "p").mapInArrow(work, "ticker string, setting int, block bigint, map array<int>")


def entries(table: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """(ticker, setting, block, entry): the state each block starts from; the first starts from the empty one (0)."""
    keys = ["ticker", "setting"]

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for own in frame.sort_values("block")["map"]:
            total = own if total is None else own[total]
        return frame[[*keys, "group"]].iloc[:1].assign(map=[total.tolist()])

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        state, out = int(frame["entry"].iloc[0]), []
        for own in frame["map"]:
            out.append(state)
            state = int(own[state])
        return frame[[*keys, "block"]].assign(entry=np.array(out, np.int32))

    grouped = table.withColumn("group", F.floor(F.col("block") / fan))
    if blocks <= fan:
        led = grouped.withColumn("entry", F.lit(0))
    else:
        table = written(table, "maps")
        grouped = table.withColumn("group", F.floor(F.col("block") / fan))
        above = grouped.groupBy(*keys, "group").applyInPandas(compose, "ticker string, setting int, group bigint, map array<int>").withColumnRenamed("group", "block")
        led = grouped.join(entries(above, -(-blocks // fan), fan).withColumnRenamed("block", "group"), [*keys, "group"])
    return led.groupBy(*keys, "group").applyInPandas(along, "ticker string, setting int, block bigint, entry int")


def _led(df: DataFrame, settings: list[tuple[float, float, int]], size: int, fan: int) -> tuple[DataFrame, Machine]:
    """Blocks with ``entry``: the states they start from, in the order of the settings."""
    blocks, labels, longest = cut(df, size)
    machine = Machine(labels, settings)
    found = entries(maps(blocks, machine, size), longest, fan)
    led = found.groupBy("ticker", "block").agg(F.array_sort(F.collect_list(F.struct("setting", "entry"))).alias("e")).select("ticker", "block", F.col("e.entry").alias("entry"))
    return blocks.join(led, ["ticker", "block"]), machine


def scan(df: DataFrame, hard: float, soft: float, persist: int, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(ticker, ts, raw, held) from posteriors (ticker, ts, p)."""
    led, machine = _led(df, [(hard, soft, persist)], size, fan)
    kind = df.schema["ts"].dataType.simpleString()

    def work(batches):
        for batch in _lots(batches, 1):
            p, length = _arrays(batch, machine.labels, size)
            held = np.zeros(p.shape[:2], np.int32)
            state = batch.column("entry").flatten().to_numpy().reshape(len(p), 1, 1)
            for t, _, state in machine.walk(p, length, state):
                held[:, t] = machine.held[state[:, 0, 0]]
            inside = np.arange(p.shape[1]) < length[:, None]
            row = pa.array(np.repeat(np.arange(len(p)), length))
            yield pa.RecordBatch.from_arrays([batch.column("ticker").take(row), batch.column("ts").flatten(), pa.array(p.argmax(axis=2).astype(np.int32)[inside]), pa.array(held[inside])], ["ticker", "ts", "raw", "held"])

    return led.mapInArrow(work, f"ticker string, ts {kind}, raw int, held int")


def flip_counts(df: DataFrame, settings: list[tuple[float, float, int]], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(ticker, setting, n, raw_flips, held_flips, same): every setting on every series, counted block by block.

    A block counts the held flips of its bars against the bar before, which its first state knows; raw flips across
    blocks are told from each block's last raw label, carried by position."""
    led, machine = _led(df, settings, size, fan)

    def work(batches):
        n = len(machine.settings)
        for batch in _lots(batches, n):
            p, length = _arrays(batch, machine.labels, size)
            raw = p.argmax(axis=2)
            state = batch.column("entry").flatten().to_numpy().reshape(len(p), n, 1)
            before, flips, same = machine.held[state[:, :, 0]], np.zeros((len(p), n), np.int64), np.zeros((len(p), n), np.int64)
            for t, live, state in machine.walk(p, length, state):
                held = machine.held[state[:, :, 0]]
                flips += live[:, None] & (before >= 0) & (held != before)
                same += live[:, None] & (held == raw[:, t, None])
                before = held
            inside = (np.arange(1, p.shape[1]) < length[:, None]) & (raw[:, 1:] != raw[:, :-1])
            row = pa.array(np.repeat(np.arange(len(p)), n))
            ends = raw[np.arange(len(p)), np.maximum(length - 1, 0)]
            columns = [np.tile(np.arange(n, dtype=np.int32), len(p)), np.repeat(length, n), np.repeat(inside.sum(axis=1), n), flips.ravel(), same.ravel(), np.repeat(raw[:, 0], n), np.repeat(ends, n)]
            yield pa.RecordBatch.from_arrays([batch.column("ticker").take(row), batch.column("block").take(row), *(pa.array(c) for c in columns)], ["ticker", "block", "setting", "n", "raw_flips", "held_flips", "same", "first", "last"])

    each = written(led.mapInArrow(work, "ticker string, block bigint, setting int, n bigint, raw_flips bigint, held_flips bigint, same bigint, first bigint, last bigint"), "flips")
    ends = each.select("ticker", (F.col("block") + 1).alias("block"), "setting", F.col("last").alias("before"))
    own = each.join(ends, ["ticker", "block", "setting"], "left")
    return own.groupBy("ticker", "setting").agg(F.sum("n").alias("n"), F.sum(F.col("raw_flips") + F.coalesce((F.col("first") != F.col("before")).cast("int"), F.lit(0))).alias("raw_flips"), F.sum("held_flips").alias("held_flips"), F.sum("same").alias("same"))

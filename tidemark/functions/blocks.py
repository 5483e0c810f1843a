"""Windows and running values of long series in many tasks.

A ticker's bars are numbered in two levels (within buckets of time, and over the buckets' counts), and dealt
into blocks of ``SIZE`` consecutive bars.  A bounded frame is computed inside a block that also holds the bars
its frames reach back or ahead (the halo); what depends on the whole past is computed in each block, and the
blocks' totals are scanned and carried in.  No task holds a whole series.

``(ticker, ts)`` tells bars apart, so a bucket of ``BUCKET`` days (or seconds) has as many bars at most as
``ts`` has different values in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bars of a block, and days (of dates) or seconds (of timestamps) of a bucket.
SIZE, BUCKET = 2048, {"date": 1024, "timestamp": 65_536, "timestamp_ntz": 65_536}


def _free(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name


def _clock(df: DataFrame) -> Column:
    kind = df.schema["ts"].dataType.simpleString()
    if kind == "date":
        return F.floor(F.unix_date("ts") / BUCKET[kind])
    if kind in BUCKET:
        return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / BUCKET[kind])
    return F.floor(F.col("ts") / BUCKET["date"])  # numbers


def numbered(df: DataFrame, out: str = "at") -> DataFrame:
    """``df`` with the number of each bar among its ticker's, from 0."""
    bucket, before, k = (_free(n, df) for n in ("bucket", "before", "k"))
    own = df.withColumn(bucket, _clock(df))
    sizes = own.groupBy("ticker", bucket).agg(F.count("*").alias(before))
    earlier = Window.partitionBy("ticker").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("ticker", bucket, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    inside = own.withColumn(k, F.row_number().over(Window.partitionBy("ticker", bucket).orderBy("ts")))
    return inside.join(sizes, ["ticker", bucket]).withColumn(out, F.col(before) + F.col(k) - 1).drop(bucket, before, k)


def within(df: DataFrame, compute: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, size: int = SIZE, number: str | None = None) -> DataFrame:
    """``compute(df)``, block by block; ``number``: the column of the bars' numbers, where ``df`` is ``numbered``.

    ``compute`` may use any operator whose windows are partitioned by ticker and whose results for a bar depend on
    no more than the ``back`` bars before it and the ``ahead`` bars after it; it keeps rows and the columns ticker
    and ts.  Inside, ``ticker`` is the ticker with its block."""
    at, block, own = (_free(n, df) for n in ("at", "block", "own"))
    rows, at = (df, number) if number else (numbered(df, at), at)
    here = F.floor(F.col(at) / size)
    reach = F.sequence(F.floor((F.col(at) - ahead) / size), F.floor((F.col(at) + back) / size))
    dealt = rows.withColumn(block, F.explode(reach)).where(F.col(block) >= 0)
    dealt = dealt.withColumn(own, F.col(block) == here).withColumn("ticker", F.struct("ticker", block)).drop(block, *([] if number else [at]))
    return compute(dealt).where(own).withColumn("ticker", F.col("ticker.ticker")).drop(own)


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with aggregates of each ticker's whole series: grouped map-side and joined back, no window."""
    return df.join(df.groupBy("ticker").agg(*(c.alias(n) for n, c in totals.items())), "ticker")


def _carried(df: DataFrame, at: str, size: int, inside: Callable, total: Callable, over: Callable, join: Callable, out: str) -> DataFrame:
    """Running values: ``inside`` a block, the blocks' ``total``, these ``over`` the blocks before, both ``join``ed."""
    block, carry = _free("block", df), _free("carry", df)
    own = df.withColumn(block, F.floor(F.col(at) / size))
    sums = own.groupBy("ticker", block).agg(total().alias(carry))
    earlier = Window.partitionBy("ticker").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("ticker", block, over(carry, earlier).alias(carry))
    here = Window.partitionBy("ticker", block).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn(out, inside(here)).join(sums, ["ticker", block]).withColumn(out, join(F.col(out), F.col(carry))).drop(block, carry)


def running_sum(df: DataFrame, x: str, out: str, at: str = "at", size: int = SIZE) -> DataFrame:
    """Sum of ``x`` from the ticker's first bar to each (null before any value); ``df`` is ``numbered``."""
    return _carried(
        df, at, size, lambda w: F.sum(x).over(w), lambda: F.sum(x), lambda c, w: F.sum(c).over(w),
        lambda own, before: F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0))), out)


def carried_last(df: DataFrame, x: str, out: str, at: str = "at", size: int = SIZE) -> DataFrame:
    """The last value of ``x`` up to each bar; ``df`` is ``numbered``."""
    return _carried(
        df, at, size, lambda w: F.last(x, ignorenulls=True).over(w), lambda: F.max_by(x, F.when(F.col(x).isNotNull(), F.col(at))),
        lambda c, w: F.last(c, ignorenulls=True).over(w), lambda own, before: F.coalesce(own, before), out)


def affine_scan(df: DataFrame, b: Column, c: Column, start: float, out: str, at: str = "at", size: int = 256, bars: int | None = None) -> DataFrame:
    """``out``[t] of x[t+1] = b[t] x[t] + c[t], x[0] = ``start``, along each ticker; ``df`` is ``numbered``.

    Steps compose: (b, c) after (b', c') is (b b', b c' + c).  Inside a block of ``size`` bars, each bar composes
    with the one 1, 2, 4, ... bars before, so that log2(size) lags give the composition of all up to it; the blocks'
    compositions are a series of their own, scanned the same way, until a ticker has one block.  Only expressions.  ``bars``: the longest series, counted if
    not given."""
    block, last, bb, cc, x0 = (_free(n, df.withColumn(out, F.lit(0))) for n in ("block", "last", "bb", "cc", "x0"))
    own = df.withColumns({block: F.floor(F.col(at) / size), bb: b.cast("double"), cc: c.cast("double")})
    w = Window.partitionBy("ticker", block).orderBy(at)
    step = 1
    while step < size:
        before_b, before_c = F.coalesce(F.lag(bb, step).over(w), F.lit(1.0)), F.coalesce(F.lag(cc, step).over(w), F.lit(0.0))
        own = own.withColumns({cc: F.col(bb) * before_c + F.col(cc), bb: F.col(bb) * before_b})
        step *= 2
    bars = bars or (df.agg(F.max(at)).first()[0] or 0) + 1
    blocks = -(-bars // size)
    if blocks == 1:
        entry = own.withColumn(x0, F.lit(float(start)))
    else:
        totals = own.groupBy("ticker", block).agg(F.max_by(F.struct(bb, cc), at).alias(last)).select("ticker", F.col(block), F.col(f"{last}.{bb}").alias("b"), F.col(f"{last}.{cc}").alias("c"))
        entry = own.join(affine_scan(totals, F.col("b"), F.col("c"), start, x0, block, size, blocks).select("ticker", block, x0), ["ticker", block])
    before_b, before_c = F.coalesce(F.lag(bb).over(w), F.lit(1.0)), F.coalesce(F.lag(cc).over(w), F.lit(0.0))
    return entry.withColumn(out, before_b * F.col(x0) + before_c).drop(block, bb, cc, x0)

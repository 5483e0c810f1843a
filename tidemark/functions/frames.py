"""Window frames and guarded aggregates.

Two frame conventions: ``before(n)`` is the n bars before the current one (features have one bar of
lag), ``upto(n)`` ends with the current bar.  ``full`` blanks an aggregate until its frame is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

YEAR = 252


def w(*order: str) -> Window:
    return Window.partitionBy("ticker").orderBy(*(order or ("ts",)))


def before(n: int):
    return w().rowsBetween(-n, -1)


def upto(n: int):
    return w().rowsBetween(-(n - 1), 0)


def after(n: int):
    return w().rowsBetween(1, n)


def so_far():
    return w().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    return Window.partitionBy("ticker")


def full(value: Column, counted: Column | str, frame, least: int) -> Column:
    """``value`` where ``frame`` holds ``least`` non-null rows or more of ``counted``, else null."""
    return F.when(F.count(counted).over(frame) >= least, value)


def number() -> Column:
    return F.row_number().over(w())


def nonzero(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.nullif(x, F.lit(0.0))


def filled(x: str) -> Column:
    """Last value carried forward."""
    return F.last(x, ignorenulls=True).over(so_far())


def z_score(x: str, frame, least: int = 1) -> Column:
    """(x - mean) / sample deviation over a frame; null while it holds fewer than ``least`` values or none vary."""
    return full((F.col(x) - F.avg(x).over(frame)) / nonzero(F.stddev_samp(x).over(frame)), x, frame, least)


def min_max(x: str, frame, least: int) -> Column:
    """Position between the frame's least and largest value, in [0, 1]; a frame without spread divides by 1e-8."""
    lo, hi = F.min(x).over(frame), F.max(x).over(frame)
    spread = F.when(hi == lo, 1e-8).otherwise(hi - lo)
    return full(F.least(F.greatest((F.col(x) - lo) / spread, F.lit(0.0)), F.lit(1.0)), x, frame, least)


def islands(df: DataFrame, label: str) -> DataFrame:
    """(ticker, run, label, first_ts, last_ts, n_bars): maximal runs of equal labels; nulls are skipped."""
    own = df.where(F.col(label).isNotNull())
    change = F.coalesce((F.col(label) != F.lag(label).over(w())).cast("int"), F.lit(0))
    runs = own.withColumn("change", change).withColumn("run", F.sum("change").over(so_far()))
    return runs.groupBy("ticker", "run", label).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"))


def only_finite(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null: missing values are null everywhere behind the sources."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.when(F.abs(F.col(n)) < float("inf"), F.col(n)) for n in doubles})

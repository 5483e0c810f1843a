"""Returns, moving averages, and forward outcomes of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.blocks import numbered, running_sum
from ..functions.frames import YEAR, after, full, nonzero, upto, w


def log_returns(bars: DataFrame, price: str = "close", out: str = "lr") -> DataFrame:
    """ln(price / previous price); null at the first bar and where a price isn't positive."""
    ratio = F.col(price) / nonzero(F.lag(price).over(w()))
    return bars.withColumn(out, F.when(ratio > 0, F.ln(ratio)))


def simple_returns(bars: DataFrame, *steps: int) -> DataFrame:
    return bars.withColumns({f"ret{k}": F.col("close") / nonzero(F.lag("close", k).over(w())) - 1 for k in steps})


def moving_average(bars: DataFrame, n: int = 20) -> DataFrame:
    """``sma{n}`` over full windows, and whether the close is above it (false while either is missing)."""
    mean = full(F.avg("close").over(upto(n)), "close", upto(n), n)
    return bars.withColumn(f"sma{n}", mean).withColumn(f"above_sma{n}", F.coalesce(F.col("close") > F.col(f"sma{n}"), F.lit(False)))


def rolling_volatility(df: DataFrame, n: int = 22, x: str = "lr") -> DataFrame:
    """Annualised sample deviation in percent."""
    return df.withColumn(f"rv{n}", full(F.stddev_samp(x).over(upto(n)) * F.sqrt(F.lit(float(YEAR))) * 100, x, upto(n), n))


def forward_volatility(df: DataFrame, *horizons: int, x: str = "lr") -> DataFrame:
    return df.withColumns({f"fv{h}": full(F.stddev_samp(x).over(after(h)) * F.sqrt(F.lit(float(YEAR))) * 100, x, after(h), h) for h in horizons})


def forward_drawdown(df: DataFrame, *horizons: int) -> DataFrame:
    """Lowest close of the next h bars against the current close, in percent."""
    return df.withColumns({f"fdd{h}": full((F.min("close").over(after(h)) / nonzero("close") - 1) * 100, "close", after(h), h) for h in horizons})


def forward_runup(df: DataFrame, h: int = 10) -> DataFrame:
    """|min(0, (close - highest close of the h bars from here on) / close)| in percent: how far prices rise."""
    frame = w().rowsBetween(0, h - 1)
    low = F.least(F.lit(0.0), (F.col("close") - F.max("close").over(frame)) / nonzero("close") * 100)
    return df.withColumn(f"runup{h}", full(F.abs(low), "close", frame, h))


def rebased(df: DataFrame, base: float = 1000.0, x: str = "lr") -> DataFrame:
    """A price path of the returns from ``base`` on: a cumulative product as a sum of logarithms, carried from block to block."""
    own = running_sum(numbered(df.withColumn("path", F.coalesce(F.col(x), F.lit(0.0)))), "path", "path")
    return own.withColumn("path", F.lit(base) * F.exp("path")).drop("at")

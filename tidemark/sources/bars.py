"""OHLCV bars (ticker, ts, open, high, low, close, volume): from files, and built from transactions."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.frames import filled, only_finite, w

SCHEMA = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("ts", T.DateType()), *(T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume"))])
#: Names that files give the columns, whatever their case and padding (fixed values).
DATE_NAMES = ("date", "time", "ngay", "ngày")
PRICE_NAMES = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """Columns by their canonical names; a missing volume is null; ascending gaps are carried forward."""
    by_name = {c.strip().lower(): c for c in df.columns}
    date = next((by_name[n] for n in DATE_NAMES if n in by_name), None)
    if date is None or "close" not in by_name:
        raise ValueError(f"no date or close column among {df.columns}")
    own = F.col(f"`{by_name['ticker']}`") if "ticker" in by_name else F.lit(ticker or "ALL")
    cols = [F.col(f"`{by_name[n]}`").cast("double").alias(n) if n in by_name else F.lit(None).cast("double").alias(n) for n in PRICE_NAMES]
    bars = only_finite(df.select(own.alias("ticker"), F.to_date(F.col(f"`{date}`")).alias("ts"), *cols))
    return bars.withColumns({n: filled(n) for n in PRICE_NAMES})


def load(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """Bars of a CSV, Parquet or Excel file, by its suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return canonical(spark.read.option("header", True).option("inferSchema", True).csv(path), ticker)
    if suffix == "parquet":
        return canonical(spark.read.parquet(path), ticker)
    if suffix in ("xls", "xlsx"):
        import pandas as pd  # needs an Excel reader beside pandas

        return canonical(spark.createDataFrame(pd.read_excel(path)), ticker)
    raise ValueError(f"unknown file type: {path}")


def with_fallback(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame] | None = None) -> DataFrame:
    """``primary``'s rows, or ``fallback``'s where the source cannot be read, has no bars in it, or has no rows."""
    try:
        df = primary()
        if not df.isEmpty():
            return df
        failure: Exception = ValueError("the source has no rows")
    except (PySparkException, Py4JJavaError, OSError, ValueError) as e:  # no file, no permission, no such columns; not errors of the code
        failure = e
    if fallback is None:
        raise failure
    return fallback()


def between(bars: DataFrame, first: str, last: str) -> DataFrame:
    """Inclusive date slice; windows after it start anew."""
    return bars.where(F.col("ts").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def guard(bars: DataFrame, least: int) -> DataFrame:
    """(ticker, n_bars, status): whether a ticker has enough bars."""
    return bars.groupBy("ticker").agg(F.count("*").alias("n_bars")).withColumn("status", F.when(F.col("n_bars") >= least, "ok").otherwise("too_short"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def _ohlc(df: DataFrame, ticker, ts, price, volume, order) -> DataFrame:
    rows = df.select(ticker.alias("ticker"), ts.alias("ts"), price.alias("px"), volume.alias("v"), F.struct(*order).alias("k"))
    return rows.groupBy("ticker", "ts").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("v").alias("volume"))


#: Line items have no key of their own; together these tell them apart.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument from line items: unit price by ship date."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return _ohlc(lines, F.lit("ALL"), F.to_date("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), LINE_ORDER)


def by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 instruments: line items by the brand of their part."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return _ohlc(lines, F.col("p_brand"), F.to_date("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), LINE_ORDER)


def by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 instruments: order values by market segment; volume counts orders."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return _ohlc(orders, F.col("c_mktsegment"), F.to_date("o_orderdate"), F.col("o_totalprice"), F.lit(1.0), ("o_orderkey",))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of an hour from events; volume counts them."""
    return _ohlc(table(spark, sf_dir, "events"), F.lit("ALL"), F.date_trunc("hour", "ts"), F.col("value"), F.lit(1.0), ("ts", "event_id"))


def basket_returns(bars: DataFrame) -> DataFrame:
    """(ts, ticker, ret): closes on the union calendar, carried forward, as simple returns; dates without any are dropped."""
    # the calendar is one array of days, exploded for each instrument
    calendar = bars.agg(F.collect_set("ts").alias("days"))
    grid = bars.select("ticker").distinct().join(calendar).select("ticker", F.explode("days").alias("ts"))
    panel = grid.join(bars.select("ticker", "ts", "close"), ["ticker", "ts"], "left").withColumn("close", filled("close"))
    own = panel.select("ts", "ticker", (F.col("close") / F.lag("close").over(w()) - 1).alias("ret"))
    has = own.groupBy("ts").agg(F.count("ret").alias("n")).where("n > 0").select("ts")
    return own.join(has, "ts", "left_semi")

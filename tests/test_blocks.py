"""Blocks with a halo, carried values and scans against plain windows and loops."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import blocks as K
from tidemark.functions.frames import filled, so_far, upto, w
from tidemark.operators import entropy as E, returns as R
from tidemark.sources import bars as B

DAY = datetime.date(2001, 1, 1)


def rows_of(df, digits=9):
    fix = lambda v: round(v, digits) + 0.0 if isinstance(v, float) else v
    cols = sorted(df.columns)
    return {(r["ticker"], r["ts"]): tuple(fix(r[c]) for c in cols) for r in df.collect()}


def equal(a, b):
    x, y = rows_of(a), rows_of(b)
    assert x.keys() == y.keys() and sorted(a.columns) == sorted(b.columns)
    for k in x:
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-7, abs_tol=1e-7)) for u, v in zip(x[k], y[k])), (k, x[k], y[k])


@pytest.fixture(scope="module")
def brands(spark):
    """Uneven series: one ticker with most bars, gaps of years, one bar alone."""
    rng = random.Random(4)
    rows = []
    for ticker, n, step in (("hot", 900, 1), ("gaps", 60, 97), ("one", 1, 1), (None, 30, 3)):
        for k in range(n):
            rows.append((ticker, DAY + datetime.timedelta(days=k * step), *([100 * math.exp(rng.gauss(0, 0.1))] * 4), None if rng.random() < 0.1 else float(rng.randint(0, 50))))
    return spark.createDataFrame(rows, B.SCHEMA).repartition(4)


def test_numbers(brands):
    plain = brands.withColumn("n", F.row_number().over(w()) - 1)
    got = K.numbered(brands.where("ticker IS NOT NULL"))
    assert {(r["ticker"], r["ts"]): r["at"] for r in got.collect()} == {(r["ticker"], r["ts"]): r["n"] for r in plain.where("ticker IS NOT NULL").collect()}
    hours = brands.where("ticker IS NOT NULL").withColumn("ts", F.timestamp_add("HOUR", F.lit(7), F.col("ts").cast("timestamp")))
    assert [r["at"] for r in K.numbered(hours).where("ticker = 'gaps'").orderBy("ts").collect()] == list(range(60))
    assert K.numbered(brands.where("ticker = 'none'")).count() == 0


@pytest.mark.parametrize("size", [16, 64, 5000])
def test_features_in_blocks_equal_plain_ones(brands, size):
    own = brands.where("ticker IS NOT NULL")
    equal(E.permutation_entropy_in_blocks(own, size), E.permutation_entropy(R.log_returns(own)))
    equal(E.volume_base_in_blocks(own, size), E.volume_base(own))


def test_all_features_in_blocks(spark, brands):
    own = brands.where("ticker IS NOT NULL")
    equal(E.price_features_in_blocks(own, 128), E.price_features(own))
    equal(E.volume_entropy_in_blocks(own.na.fill(3.0), 100), E.volume_entropy(own.na.fill(3.0)))
    cse = own.select("ts").distinct().where("day(ts) = 3").withColumn("cse", F.day("ts") + F.month("ts").cast("double"))
    equal(E.joined_breadth_in_blocks(own, cse), E.joined_breadth(own, cse))
    daily = B.daily(spark, DATA)
    equal(E.price_features_in_blocks(daily, 256), E.price_features(daily))


def test_frames_ahead(brands):
    own = brands.where("ticker IS NOT NULL")
    equal(K.within(own, lambda x: R.forward_drawdown(x, 5, 20), 0, 20, size=32), R.forward_drawdown(own, 5, 20))


@pytest.mark.parametrize("size", [8, 256])
def test_running_values(brands, size):
    own = K.numbered(brands.where("ticker IS NOT NULL"))
    equal(K.running_sum(own, "volume", "x", size=size), own.withColumn("x", F.sum("volume").over(so_far())))
    equal(K.carried_last(own, "volume", "x", size=size), own.withColumn("x", filled("volume")))


@pytest.mark.parametrize("size", [2, 8, 64, 1024])
def test_affine_scan(brands, size):
    own = K.numbered(brands.where("ticker IS NOT NULL")).withColumns({"b": F.when(F.col("close") > 100, 0.9).otherwise(0.0), "c": F.col("close") / 50})
    got = {(r["ticker"], r["at"]): r["x"] for r in K.affine_scan(own, F.col("b"), F.col("c"), 7.0, "x", size=size).collect()}
    for ticker in ("hot", "gaps", "one"):
        x = 7.0
        for r in own.where(F.col("ticker") == ticker).orderBy("at").collect():
            assert math.isclose(got[ticker, r["at"]], x, rel_tol=1e-12)
            x = r["b"] * x + r["c"]


def test_no_task_holds_a_series(spark, brands):
    """With a task for each block, the fullest holds under two blocks' shares of the rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = brands.where("ticker = 'hot'")
        dealt = K.within(own, lambda x: x.withColumns({"m": F.avg("close").over(upto(20)), "t": F.col("ticker")}), 24, size=90)
        sizes = [r["count"] for r in dealt.groupBy("t").count().collect()]
        assert len(sizes) == 10 and max(sizes) <= 2 * 900 / 10
        assert "SinglePartition" not in dealt._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_flat_series_have_no_correlation(spark):
    from tidemark.operators import stats as S, volatility as V

    rng = np.random.default_rng(3)
    days = [DAY + datetime.timedelta(days=k) for k in range(60)]
    rows = [(d, "a", 0.0 if 10 <= k < 45 else float(rng.standard_normal())) for k, d in enumerate(days)] + [(d, "b", 1.5 if 20 <= k < 50 else float(rng.standard_normal())) for k, d in enumerate(days)]
    returns = spark.createDataFrame(rows, "ts date, ticker string, ret double")
    two = S.correlations(returns, 22).select("ts", E.two_asset_entropy(F.col("r"), F.col("flat_a"), F.col("flat_b")).alias("two"))
    both = {r["ts"]: (r["two"], r["cse"]) for r in two.join(E.correlation_entropy(returns), "ts").collect()}
    assert len(both) == 38
    for two_, full in both.values():
        assert (two_ is None) == (full is None) and (two_ is None or abs(two_ - full) < 1e-6)
    assert sum(v[0] is None for v in both.values()) > 0 and sum(v[0] == 0.0 for v in both.values()) > 5
    ratio = V.breadth_ratio(two.select(F.lit("x").alias("ticker"), "ts", F.when(F.col("two").isNull(), None).otherwise(0.0).alias("cse")))
    assert {r["ce_ratio"] for r in ratio.where("cse IS NULL").collect()} == {None}


@pytest.mark.parametrize("window, m, r, share", [(60, 2, None, 0.2), (60, 2, 0.2, 0.2), (12, 3, None, 0.5), (20, 1, 0.4, 0.2), (4, 2, 1.0, 0.2)])
def test_sample_entropy_of_all_windows_at_once(window, m, r, share):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.standard_normal(150), 1), np.full(70, 0.5), rng.standard_normal(30)])
    got = E.sample_entropy_along(x, window, m, r, share)
    for i in range(len(x)):
        own = x[max(0, i - window) : i]
        want = math.nan if i < window or (r is None and not own.std() > 0) else E.sample_entropy(own, m, r if r is not None else share * own.std())
        assert (math.isnan(got[i]) and math.isnan(want)) or math.isclose(got[i], want, abs_tol=1e-12), (i, got[i], want)
    assert np.isnan(E.sample_entropy_along(x[:window], window, m, r, share)).all()


@pytest.mark.parametrize("size", [40, 4096])
def test_sample_entropy_with_gaps(brands, size):
    own = brands.where("ticker IN ('gaps', 'hot') AND ts < '2002-06-01'")  # volumes have gaps
    equal(E.rolling_sample_entropy_in_blocks(own, "volume", "se", 30, r=3.0, least=10, size=size), E.rolling_sample_entropy(own, "volume", "se", 30, r=3.0, least=10))
    equal(E.rolling_sample_entropy_in_blocks(own, "volume", "se", 30, size=size), E.rolling_sample_entropy(own, "volume", "se", 30))

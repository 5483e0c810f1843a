"""Validation statistics as grouped and windowed expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import so_far, w

CLIP = 1e-12


def chi2_tail(q: float, df: int) -> float:
    """P(chi-square > q) for whole degrees of freedom."""
    half = max(q, 0.0) / 2
    if df % 2:
        total = math.erfc(math.sqrt(half))
        return min(1.0, total + math.exp(-half) * sum(half ** (j - 0.5) / math.gamma(j + 0.5) for j in range(1, (df + 1) // 2)))
    term, total = 1.0, 1.0
    for k in range(1, df // 2):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def ljung_box_p(x: np.ndarray, lags: int) -> float:
    n, d = len(x), x - x.mean()
    denom = float((d * d).sum())
    if n <= lags or denom == 0:
        return 1.0
    q = n * (n + 2) * sum(float((d[k:] * d[:-k]).sum() / denom) ** 2 / (n - k) for k in range(1, lags + 1))
    return chi2_tail(q, lags)


def ljung_box(df: DataFrame, x: str, lags: int) -> DataFrame:
    """(ticker, q, p): portmanteau test of ``x`` with an even number of lags."""
    own = df.where(F.col(x).isNotNull()).select("ticker", "ts", (F.col(x) - F.avg(x).over(Window.partitionBy("ticker"))).alias("d"))
    own = own.withColumns({f"l{k}": F.col("d") * F.lag("d", k).over(w()) for k in range(1, lags + 1)})
    sums = own.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("v"), *(F.sum(f"l{k}").alias(f"s{k}") for k in range(1, lags + 1)))
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        rho = F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.nullif(F.col("v"), F.lit(0.0))
        q = q + rho * rho / F.nullif(F.col("n") - k, F.lit(0))
    out = sums.select("ticker", (F.col("n") * (F.col("n") + 2) * q).alias("q"))
    half, term, total = F.col("q") / 2, F.lit(1.0), F.lit(1.0)
    for k in range(1, lags // 2):
        term = term * half / k
        total = total + term
    return out.withColumn("p", F.least(F.lit(1.0), F.exp(-half) * total))


def group_stats(df: DataFrame, label: str, *values: str, least: int = 1) -> DataFrame:
    """Long form: (label, measure, n, mean, median, sd) by group, groups of ``least`` values or more."""
    parts = None
    for v in values:
        own = df.where(F.col(v).isNotNull() & F.col(label).isNotNull()).groupBy(label).agg(
            F.lit(v).alias("measure"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.where(F.col("n") >= least)


def spread(df: DataFrame, label: str, value: str) -> DataFrame:
    """(spread): largest less smallest group mean."""
    means = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(label).agg(F.avg(value).alias("m"))
    return means.agg((F.max("m") - F.min("m")).alias("spread"))


def octave_bin(x: Column, parts: int = 256) -> Column:
    """A number that never falls as ``x`` grows: the ``parts``-th of an octave that x lies in."""
    return F.when(x == 0, F.lit(0)).otherwise((F.signum(x) * (F.floor(F.log2(F.abs(x)) * parts) + 2048 * parts)).cast("bigint"))


def kruskal(df: DataFrame, label: str, value: str, least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, k, h, p): rank test over the groups with ``least`` values or more, tie-corrected, for each ``by``;
    a single group, or values that are all equal, give a null h and p.

    Ranks count distinct values within a bin and add the bins below, so no window holds the whole column."""
    by = list(by)
    own = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(label).alias("g"), F.col(value).cast("double").alias("x"))
    sizes = own.groupBy(*by, "g").agg(F.count("*").alias("n_g")).where(F.col("n_g") >= least)
    cells = own.groupBy(*by, "g", "x").agg(F.count("*").alias("c")).join(sizes.select(*by, "g"), [*by, "g"], "left_semi")
    counts = cells.groupBy(*by, "x").agg(F.sum("c").alias("t")).withColumn("bin", octave_bin(F.col("x")))
    up = Window.partitionBy(*by, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(*by, "bin").agg(F.sum("t").alias("n"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    bins = bins.withColumn("below", F.coalesce(F.sum("n").over(over), F.lit(0)))
    inside = F.coalesce(F.sum("t").over(up), F.lit(0))
    ranks = counts.withColumn("inside", inside).join(bins.select(*by, "bin", "below"), [*by, "bin"]).select(*by, "x", (F.col("below") + F.col("inside") + (F.col("t") + 1) / 2).alias("r"))
    groups = cells.join(ranks, [*by, "x"]).groupBy(*by, "g").agg(F.sum(F.col("r") * F.col("c")).alias("s"), F.sum("c").alias("n_g"))
    out = groups.groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n_g")).alias("q"))
    total = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("ties").alias("ties"))
    out = out.join(total, by) if by else out.join(total)  # without ``by`` both are one row
    n = F.col("n").cast("double")
    spread = 1 - F.col("ties") / F.nullif(n * n * n - n, F.lit(0.0))
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.when(spread > 0, spread)
    out = out.select(*by, "n", "k", F.when(F.col("k") > 1, h).alias("h"))

    @F.pandas_udf("double")
    def tail(q: pd.Series, k: pd.Series) -> pd.Series:  # a row for each test
        return pd.Series([None if v is None or math.isnan(v) else chi2_tail(v, int(d) - 1) for v, d in zip(q, k, strict=True)], dtype=float)

    return out.withColumn("p", F.nanvl(tail("h", "k"), F.lit(None).cast("double")))


def hit_rates(df: DataFrame, label: str, values: list[str], thresholds: list[float], below: bool = True) -> DataFrame:
    """(label, measure, threshold, n, rate): share of values beyond each threshold."""
    measures = F.explode(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).alias("x")) for v in values)))
    own = df.where(F.col(label).isNotNull()).select(label, measures.alias("m")).select(label, "m.*").where("x IS NOT NULL")
    own = own.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    hit = F.col("x") < F.col("threshold") if below else F.col("x") > F.col("threshold")
    return own.groupBy(label, "measure", "threshold").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"))


def lift(df: DataFrame, label: str, value: str, threshold: float) -> DataFrame:
    """(label, rate, base_rate, lift): a group's rate of values above the threshold against that of all."""
    own = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).withColumn("hit", (F.col(value) > threshold).cast("double"))
    base = own.agg(F.avg("hit").alias("base_rate"))
    out = own.groupBy(label).agg(F.avg("hit").alias("rate")).join(base)
    return out.withColumn("lift", F.try_divide("rate", "base_rate"))


def lift_between(df: DataFrame, label: str, high: str, low: str, values: list[str], thresholds: list[float], below: bool = True) -> DataFrame:
    """(measure, threshold, n_high, n_low, rate_high, rate_low, lift): how much more often values of one group lie beyond a
    threshold than those of another.  Only rows with all values count; a rate without rows, and a lift over a rate of 0, are 0."""
    complete = df.where(F.col(label).isin(high, low)).dropna(subset=values).select((F.col(label) == high).alias("own"), *values)
    beyond = lambda v, t: F.col(v) < t if below else F.col(v) > t
    count = lambda mine, v, t: F.count_if((F.col("own") == mine) & beyond(v, float(t)))
    cells = [F.struct(F.lit(v).alias("measure"), F.lit(float(t)).alias("threshold"), count(True, v, t).alias("a"), count(False, v, t).alias("b")) for v in values for t in thresholds]
    one = complete.agg(F.count_if("own").alias("n_high"), F.count_if(~F.col("own")).alias("n_low"), F.array(*cells).alias("cells"))  # one row
    rate = lambda x, n: F.coalesce(F.try_divide(x, F.col(n)), F.lit(0.0))
    out = one.select("n_high", "n_low", F.inline("cells"))
    out = out.select("measure", "threshold", "n_high", "n_low", rate("a", "n_high").alias("rate_high"), rate("b", "n_low").alias("rate_low"))
    return out.withColumn("lift", F.coalesce(F.try_divide("rate_high", "rate_low"), F.lit(0.0)))


def lift_by(df: DataFrame, by: str, label: str, value: str, thresholds: list[float]) -> DataFrame:
    """(by, label, threshold, n, rate, base_rate, lift): within each ``by``, a group's rate of values above a threshold
    against that of all its rows, those without a label too; null where the base is 0.  Groups are counted once, the base
    is summed from their counts."""
    at = [float(t) for t in thresholds]
    hits = F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(value) > t).alias("hits")) for t in at))
    each = df.where(F.col(value).isNotNull()).groupBy(by, label).agg(F.count("*").alias("n"), hits.alias("h")).select(by, label, "n", F.inline("h"))
    all_ = Window.partitionBy(by, "threshold")
    out = each.select(by, label, "threshold", "n", (F.col("hits") / F.col("n")).alias("rate"), (F.sum("hits").over(all_) / F.sum("n").over(all_)).alias("base_rate"))
    return out.withColumn("lift", F.try_divide("rate", "base_rate")).where(F.col(label).isNotNull())


def lead_lag(df: DataFrame, x: str, y: str, *leads: int) -> DataFrame:
    """(ticker, lead, r): correlation of x with y some bars later."""
    own = df.withColumns({f"y{k}": F.lead(y, k).over(w()) if k else F.col(y) for k in leads})
    each = own.groupBy("ticker").agg(*(F.corr(x, f"y{k}").alias(f"r{k}") for k in leads))
    return each.select("ticker", F.inline(F.array(*(F.struct(F.lit(k).alias("lead"), F.col(f"r{k}").alias("r")) for k in leads))))


def forecast_scores(df: DataFrame, realised: str, *forecasts: str) -> DataFrame:
    """(ticker, forecast, qlike, mse, r, r_sigma) of variance forecasts, in one pass; r_sigma correlates the roots."""
    def scores(f):
        known = F.col(realised).isNotNull() & F.col(f).isNotNull()
        y, x = F.when(known, F.col(realised)), F.when(known, F.col(f))
        u = F.when(known, F.greatest(y, F.lit(CLIP)) / F.greatest(x, F.lit(CLIP)))
        return F.struct(
            F.lit(f).alias("forecast"), F.avg(u - F.ln(u) - 1).alias("qlike"), F.avg((y - x) * (y - x)).alias("mse"), F.corr(y, x).alias("r"),
            F.corr(F.sqrt(F.when(y >= 0, y)), F.sqrt(F.when(x >= 0, x))).alias("r_sigma")).alias(f)

    own = df.groupBy("ticker").agg(*(scores(f) for f in forecasts))
    return own.select("ticker", F.inline(F.array(*forecasts))).where("qlike IS NOT NULL")


def forecast_verdict(scores: DataFrame, model: str, bench: str, least: float = 0.2) -> DataFrame:
    """``scores`` with improvement_pct of the model over the benchmark, and PASS (better, and r_sigma over ``least``),
    PARTIAL (better only) or FAIL."""
    of = lambda f, x: F.max(F.when(F.col("forecast") == f, F.col(x))).over(Window.partitionBy("ticker"))
    own = scores.withColumns({"_m": of(model, "qlike"), "_b": of(bench, "qlike"), "_r": of(model, "r_sigma")})
    better = F.coalesce(F.col("_m") < F.col("_b"), F.lit(False))
    own = own.withColumns({"improvement_pct": (1 - F.col("_m") / F.nullif(F.col("_b"), F.lit(0.0))) * 100, "verdict": F.when(better & (F.col("_r") > least), "PASS").when(better, "PARTIAL").otherwise("FAIL")})
    return own.drop("_m", "_b", "_r")


def cumulative_advantage(df: DataFrame, realised: str, model: str, bench: str) -> DataFrame:
    """Running sum of how much better the model's QLIKE is."""
    def loss(f):
        u = F.greatest(F.col(realised), F.lit(CLIP)) / F.greatest(F.col(f), F.lit(CLIP))
        return u - F.ln(u) - 1

    own = df.where(F.col(realised).isNotNull() & F.col(model).isNotNull() & F.col(bench).isNotNull())
    return own.withColumn("adv", loss(bench) - loss(model)).withColumn("cum_adv", F.sum("adv").over(so_far()))


def tail_risk(df: DataFrame, x: str, level: float = 0.05) -> DataFrame:
    """(ticker, var, es): the linear quantile of x and the mean strictly below it."""
    cut = df.where(F.col(x).isNotNull()).groupBy("ticker").agg(F.percentile(x, level).alias("var"))
    return df.join(cut, "ticker").groupBy("ticker", "var").agg(F.avg(F.when(F.col(x) < F.col("var"), F.col(x))).alias("es"))


def correlations(returns: DataFrame, window: int) -> DataFrame:
    """(ts, a, b, r, flat_a, flat_b) of every pair of tickers over the ``window`` common dates before each; flat: the
    values there are all equal."""
    x, y = returns.select("ts", F.col("ticker").alias("a"), F.col("ret").alias("x")), returns.select("ts", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    both = x.join(y, "ts").where("a < b")  # listed names only: a few dozen
    frame = Window.partitionBy("a", "b").orderBy("ts").rowsBetween(-window, -1)
    spread = F.stddev_pop("x").over(frame) * F.stddev_pop("y").over(frame)
    flat = lambda c: F.min(c).over(frame) == F.max(c).over(frame)
    own = both.withColumns({"r": F.covar_pop("x", "y").over(frame) / F.nullif(spread, F.lit(0.0)), "seen": F.count("*").over(frame), "flat_a": flat("x"), "flat_b": flat("y")})
    own = own.withColumn("r", F.when(~F.col("flat_a") & ~F.col("flat_b"), F.col("r")))
    return own.where(F.col("seen") == window).select("ts", "a", "b", "r", "flat_a", "flat_b")


def winner(df: DataFrame, name: str, score: str) -> DataFrame:
    return df.agg(F.max_by(name, score).alias("winner"), F.max(score).alias("score"))

"""Entropy features of bar series.

Feature windows hold the ``window`` bars before the current one; missing values are left out and
their neighbours join.  Ordinal patterns of three values are window sums of expressions; sample and
histogram entropy need the window's values at once and run as Arrow UDFs over window arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.blocks import SIZE, carried_last, numbered, with_totals, within
from ..functions.frames import before, full, nonzero, number, upto, w, whole, z_score

WINDOW = 22
PRICE_WINDOW, VOLUME_WINDOW = 60, 60
Z_LONG, Z_YEAR = 504, 252


def pattern(a: Column, b: Column, c: Column) -> Column:
    """Ordinal pattern of three values in time order, 0 to 5; equal values keep their order."""
    return (
        F.when((a <= b) & (b <= c), 0).when((a <= c) & (c < b), 1).when((b < a) & (a <= c), 2)
        .when((c < a) & (a <= b), 4).when((b <= c) & (c < a), 3).otherwise(5)
    )


def patterns(df: DataFrame, x: str = "lr") -> DataFrame:
    """Pattern and weight (population variance) of each value with its two predecessors."""
    a, b, c = F.lag(x, 2).over(w()), F.lag(x, 1).over(w()), F.col(x)
    whole_ = a.isNotNull() & b.isNotNull() & c.isNotNull()
    mean = (a + b + c) / 3
    weight = ((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3
    return df.withColumns({"pattern": F.when(whole_, pattern(a, b, c)), "weight": F.when(whole_, weight)})


def _entropy(p: list[Column]) -> Column:
    total = F.lit(0.0)
    for x in p:
        total = total - F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    return total


def permutation_entropy(df: DataFrame, x: str = "lr", window: int = WINDOW) -> DataFrame:
    """``wpe``, ``complexity`` (Jensen-Shannon) and ``mfi`` = wpe * (1 - complexity) from the window's patterns.

    For series whose only gap is at the start, as log returns have; the window sums of the six
    patterns' weights replace the arrays."""
    inside = w().rowsBetween(-(window - 2), -1)
    first = F.count(x).over(before(window))
    base = patterns(df, x)
    sums = {f"s{k}": F.coalesce(F.sum(F.when(F.col("pattern") == k, F.col("weight"))).over(inside), F.lit(0.0)) for k in range(6)}
    base = base.withColumns({**sums, "seen": first, "at": number()})
    total = sum((F.col(f"s{k}") for k in range(1, 6)), F.col("s0"))
    p = [F.col(f"s{k}") / F.col("total") for k in range(6)]
    u = 1 / 6
    s_u = math.log(6)
    star = -((1 + u) / 2) * math.log((1 + u) / 2) - 5 * (u / 2) * math.log(u / 2)
    q0 = 1 / (star - 0.5 * s_u)
    ok = (F.col("at") > window) & (F.col("seen") >= 3) & (F.col("total") > 0)
    out = base.withColumn("total", total).withColumn("s_p", F.when(ok, _entropy(p)))
    out = out.withColumn("s_mid", F.when(ok, _entropy([(x + u) / 2 for x in p])))
    out = out.withColumn("wpe", F.col("s_p") / s_u).withColumn("complexity", q0 * (F.col("s_mid") - 0.5 * F.col("s_p") - 0.5 * s_u) * F.col("wpe"))
    return out.withColumn("mfi", F.col("wpe") * (1 - F.col("complexity"))).drop(*sums, "seen", "at", "total", "s_p", "s_mid", "pattern", "weight")


def permutation_entropy_of(x: np.ndarray, m: int, tau: int = 1) -> tuple[float, float]:
    """The same for one array and any order: (entropy, complexity)."""
    n = len(x) - (m - 1) * tau
    if n <= 0:
        return math.nan, math.nan
    cut = np.lib.stride_tricks.sliding_window_view(x, (m - 1) * tau + 1)[:, ::tau]
    code = np.argsort(cut, axis=1, kind="stable") @ (m ** np.arange(m))
    weight = np.bincount(np.unique(code, return_inverse=True)[1], cut.var(axis=1))
    if not weight.sum() > 0:
        return math.nan, math.nan
    states = math.factorial(m)
    p = np.concatenate([weight / weight.sum(), np.zeros(states - len(weight))])
    s = lambda q: float(-(q[q > 0] * np.log(q[q > 0])).sum())
    u = np.full(states, 1 / states)
    best = (u + np.eye(1, states)[0]) / 2
    h = s(p) / math.log(states)
    return h, (s((p + u) / 2) - s(p) / 2 - s(u) / 2) / (s(best) - s(u) / 2) * h


def permutation_entropy_any(df: DataFrame, m: int, tau: int = 1, window: int = WINDOW, x: str = "lr") -> DataFrame:
    """``wpe`` and ``complexity`` for any order, over window arrays."""

    @F.pandas_udf("struct<wpe:double,complexity:double>")
    def both(values: pd.Series) -> pd.DataFrame:
        found = [permutation_entropy_of(np.asarray(v, float), m, tau) if len(v) >= m else (math.nan, math.nan) for v in values]
        return pd.DataFrame(found, columns=["wpe", "complexity"]).astype(float)

    own = df.withColumn("seg", F.collect_list(x).over(before(window))).withColumn("at", number())
    out = own.withColumn("h", F.when(F.col("at") > window, both("seg")))
    return out.withColumns({"wpe": F.nanvl("h.wpe", F.lit(None)), "complexity": F.nanvl("h.complexity", F.lit(None))}).drop("seg", "at", "h")


def kinematics(df: DataFrame, x: str = "wpe") -> DataFrame:
    """First and second difference: ``v_wpe``, ``a_wpe``."""
    return df.withColumn(f"v_{x}", F.col(x) - F.lag(x).over(w())).withColumn(f"a_{x}", F.col(f"v_{x}") - F.lag(f"v_{x}").over(w()))


def sample_entropy(x: np.ndarray, m: int, r: float) -> float:
    """-ln(A/B): pairs of runs of m + 1 values within ``r`` against those of m; NaN if either is none."""
    n = len(x)
    if n < m + 2:
        return math.nan
    near = np.abs(x[:, None] - x[None, :]) <= r
    k = n - m
    both = near[:k, :k].copy()
    for i in range(1, m):
        both &= near[i : k + i, i : k + i]
    upper = np.triu_indices(k, 1)
    b = int(both[upper].sum())
    a = int((both & near[m : k + m, m : k + m])[upper].sum())
    return -math.log(a / b) if a and b else math.nan


def sample_entropy_wrapped(x: np.ndarray, m: int = 2, share: float = 0.2) -> float:
    """With r as a share of the population deviation; NaN without variance."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    return sample_entropy(x, m, share * x.std()) if len(x) and x.std() > 0 else math.nan


def rolling_sample_entropy(df: DataFrame, x: str, out: str, window: int, m: int = 2, r: float | None = None, share: float = 0.2, least: int | None = None) -> DataFrame:
    """Sample entropy of the window before each bar; r fixed, or a share of the window's deviation."""

    @F.pandas_udf("double")
    def each(values: pd.Series) -> pd.Series:
        def one(v):
            v = np.asarray(v, float)
            if r is None and not (len(v) and v.std() > 0):
                return math.nan
            return sample_entropy(v, m, r if r is not None else share * v.std())

        return values.map(one).astype(float)

    own = df.withColumn("seg", F.collect_list(x).over(before(window))).withColumn("at", number())
    ready = (F.col("at") > window) & (F.size("seg") >= (least or m + 2))
    return own.withColumn(out, F.nanvl(F.when(ready, each("seg")), F.lit(None).cast("double"))).drop("seg", "at")


def z_global(df: DataFrame, x: str, out: str) -> DataFrame:
    """Against the whole series (population deviation; looks ahead by design): null below two values, 0 everywhere without spread."""
    n, mean, sd = F.count(x).over(whole()), F.avg(x).over(whole()), F.stddev_pop(x).over(whole())
    return df.withColumn(out, F.when(n < 2, None).when(sd == 0, 0.0).otherwise((F.col(x) - mean) / nonzero(sd)))


def z_rolling(df: DataFrame, x: str, out: str, window: int = Z_LONG, least: int | None = None) -> DataFrame:
    """Against the window that ends here; blank until it holds ``least`` (all, by default) values."""
    return df.withColumn(out, z_score(x, upto(window), window if least is None else least))


def histogram_entropy_of(x: np.ndarray, bins="auto") -> float:
    x = np.asarray(x, float)
    if len(x) < 2:
        return math.nan
    count, _ = np.histogram(x, bins=bins)
    if len(count) < 2:
        return 0.0
    p = count[count > 0] / count.sum()
    return float(min(1.0, max(0.0, -(p * np.log(p)).sum() / math.log(len(count)))))


def rolling_histogram_entropy(df: DataFrame, x: str, out: str, window: int = VOLUME_WINDOW, bins="auto", least: int = 10) -> DataFrame:
    """Shannon entropy of the window's histogram, over the logarithm of its number of bins."""

    @F.pandas_udf("double")
    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda v: histogram_entropy_of(v, bins)).astype(float)

    own = df.withColumn("seg", F.collect_list(x).over(before(window))).withColumn("at", number())
    return own.withColumn(out, F.nanvl(F.when((F.col("at") > window) & (F.size("seg") >= least), each("seg")), F.lit(None).cast("double"))).drop("seg", "at")


def rolling_fixed_bins(df: DataFrame, x: str, out: str, window: int = VOLUME_WINDOW, bins: int = 10) -> DataFrame:
    """The same with a fixed number of equal bins, as expressions only."""
    own = df.withColumn("seg", F.collect_list(x).over(before(window))).withColumn("at", number())
    lo, hi = F.array_min("seg"), F.array_max("seg")
    place = F.transform("seg", lambda v: F.least(F.floor((v - F.col("lo")) / F.col("step")).cast("int"), F.lit(bins - 1)))
    own = own.withColumns({"lo": lo, "step": (hi - lo) / bins}).withColumn("place", F.when(F.col("step") > 0, place))
    terms = F.lit(0.0)
    n = F.size("seg").cast("double")
    for k in range(bins):
        p = F.size(F.filter("place", lambda v: v == F.lit(k))) / n  # noqa: B023  built at once
        terms = terms - F.when(p > 0, p * F.ln(p)).otherwise(0.0)
    ready = (F.col("at") > window) & (F.size("seg") >= 2)
    return own.withColumn(out, F.when(ready, F.when(F.col("step") > 0, terms / math.log(bins)).otherwise(0.0))).drop("seg", "at", "lo", "step", "place")


def volume_base(bars: DataFrame) -> DataFrame:
    """``lv`` = ln(1 + volume) and its two scores: whole series (0 without spread) and trailing year (growing at first)."""
    own = bars.withColumn("lv", F.log1p(F.greatest(F.col("volume"), F.lit(0.0))))
    sd = F.stddev_samp("lv").over(whole())
    own = own.withColumn("vol_global_z", F.when(F.coalesce(sd, F.lit(0.0)) > 0, (F.col("lv") - F.avg("lv").over(whole())) / nonzero(sd)).otherwise(0.0))
    return own.withColumn("vol_rolling_z", z_score("lv", upto(Z_YEAR)))


def volume_entropy(bars: DataFrame, window: int = VOLUME_WINDOW) -> DataFrame:
    """The volume plane: both scores, histogram entropy, and sample entropy with r = 0.2 of the score."""
    own = volume_base(bars)
    own = rolling_histogram_entropy(own, "vol_global_z", "vol_shannon", window)
    return rolling_sample_entropy(own, "vol_global_z", "vol_sampen", window, 2, r=0.2, least=10)


def eigenvalue_entropy(x: np.ndarray, size: int) -> float:
    """Entropy, 0 to 100, of the eigenvalues of the columns' correlations, over the logarithm of ``size``."""
    c = np.nan_to_num(pd.DataFrame(x).corr().to_numpy())
    e = np.clip(np.linalg.eigvalsh(c), 0, None)
    if size < 2 or not e.sum() > 0:
        return math.nan
    p = e[e > 0] / e.sum()
    return float(-(p * np.log(p)).sum() / math.log(size) * 100)


def correlation_entropy(returns: DataFrame, window: int = WINDOW, block: int = 256) -> DataFrame:
    """(ts, cse): entropy, 0 to 100, of the eigenvalues of the correlations of the ``window`` dates before.

    The panel stays long: dates are numbered and dealt into blocks, each with the ``window`` dates before it, and a block
    is solved in one grouped map.  Undefined correlations count as 0."""
    dates = returns.select("ts").distinct().withColumn("at", F.row_number().over(Window.orderBy("ts")) - 1)  # a number for each date
    size = returns.agg(F.count_distinct("ticker").cast("int").alias("size"))
    blocks = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + window) / block))).alias("block")
    rows = returns.select("ts", "ticker", "ret").join(dates, "ts").join(size).select("ts", "ticker", "ret", "at", "size", blocks)
    kind = returns.schema["ts"].dataType.simpleString()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index="at", columns="ticker", values="ret", aggfunc="first", dropna=False).sort_index()
        first, total, x = int(frame["block"].iloc[0]) * block, int(frame["size"].iloc[0]), wide.to_numpy(float)
        ts = frame.drop_duplicates("at").set_index("at")["ts"]
        out = [(ts[at], eigenvalue_entropy(x[i - window : i], total) if i >= window else math.nan) for i, at in enumerate(wide.index) if at >= first]
        return pd.DataFrame(out, columns=["ts", "cse"])

    solved = rows.groupBy("block").applyInPandas(solve, f"ts {kind}, cse double")
    return solved.select("ts", F.nanvl("cse", F.lit(None).cast("double")).alias("cse"))


def two_asset_entropy(rho: Column, flat_a: Column, flat_b: Column) -> Column:
    """The same for two series in closed form: eigenvalues 1 + rho and 1 - rho.  A series without spread has no
    correlation, with itself neither: eigenvalues are 0 and 1 where one is flat (entropy 0), and none where both are."""
    p, q = (1 + rho) / 2, (1 - rho) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    return F.when(flat_a & flat_b, None).when(flat_a | flat_b, 0.0).when(rho.isNotNull(), -(term(p) + term(q)) / math.log(2) * 100)


def joined_breadth(bars: DataFrame, cse: DataFrame, align: str = "post_ffill") -> DataFrame:
    """Breadth by date on every bar: carried forward where missing, or 50 with ``pre_fill0`` where never known."""
    own = bars.join(cse, "ts", "left")
    if align == "pre_fill0":
        return own.withColumn("cse", F.coalesce("cse", F.lit(50.0)))
    return own.withColumn("cse", F.last("cse", ignorenulls=True).over(w().rowsBetween(Window.unboundedPreceding, 0)))


def price_features(bars: DataFrame) -> DataFrame:
    """All price features of a bar table: lr, wpe, complexity, mfi, kinematics, price_sampen, both scores."""
    from .returns import log_returns, moving_average

    own = kinematics(permutation_entropy(log_returns(moving_average(bars))))
    own = rolling_sample_entropy(own, "close", "price_sampen", PRICE_WINDOW)
    return z_rolling(z_global(own, "price_sampen", "spe_z_global"), "price_sampen", "spe_z")


def sample_entropy_along(x: np.ndarray, window: int, m: int = 2, r: float | None = None, share: float = 0.2) -> np.ndarray:
    """Sample entropy of the ``window`` values before each place (NaN before the first full one, or where there is none).

    Pairs of runs are told apart by their lag.  With a fixed r, whether the run at a place is near the one ``lag``
    before it doesn't depend on the window, so that a window's count is a difference of running counts: ``window`` steps
    a place.  With r a share of each window's deviation, the distances of a lag are shared by all windows that hold them,
    and each is compared with the window's own r."""
    n, k = len(x), window - m
    out = np.full(n, math.nan)
    if n <= window or k < 2:
        return out
    last = np.arange(window, n)  # windows end before these places
    if r is None:
        own = np.lib.stride_tricks.sliding_window_view(x, window)[: n - window]
        limit = share * own.std(axis=1)
    near, longer = np.zeros(n - window, np.int64), np.zeros(n - window, np.int64)
    for lag in range(1, k):
        gap = np.abs(x[lag:] - x[:-lag])  # at place i: of x[i + lag] and x[i]
        runs = gap[: len(gap) - m + 1]
        for step in range(1, m):
            runs = np.maximum(runs, gap[step : len(gap) - m + 1 + step])
        more = np.maximum(runs[: len(gap) - m], gap[m:])
        pairs = k - lag  # earlier runs of a window with this lag
        for distance, total in ((runs, near), (more, longer)):
            if r is not None:
                count = np.concatenate([[0], np.cumsum(distance <= r)])
                total += count[last - window + pairs] - count[last - window]
            else:
                total += (np.lib.stride_tricks.sliding_window_view(distance, pairs)[: n - window] <= limit[:, None]).sum(axis=1)
    ok = (near > 0) & (longer > 0)
    if r is None:
        ok &= limit > 0
    out[window:][ok] = -np.log(longer[ok] / near[ok])
    return out


def rolling_sample_entropy_in_blocks(df: DataFrame, x: str, out: str, window: int, m: int = 2, r: float | None = None, share: float = 0.2, least: int | None = None, size: int = SIZE, number: str | None = None) -> DataFrame:
    """``rolling_sample_entropy`` in blocks with a halo, all windows of a block side by side.  Windows with missing values
    are taken one by one: their neighbours join.  ``number``: the bars' numbers, where ``df`` is ``numbered``."""

    def kernel(own: np.ndarray) -> np.ndarray:
        gaps = np.isnan(own)
        found = sample_entropy_along(np.where(gaps, 0.0, own), window, m, r, share)
        holes = np.concatenate([[0], np.cumsum(gaps)])
        for i in range(window, len(own)):
            if holes[i] > holes[i - window]:
                v = own[i - window : i][~gaps[i - window : i]]
                radius = r if r is not None else share * v.std() if len(v) else 0.0
                found[i] = sample_entropy(v, m, radius) if len(v) >= (least or m + 2) and radius > 0 else math.nan
        return found

    at = number or "at_"
    rows = (df if number else numbered(df, at)).drop(out)
    dealt = rows.withColumn("block_", F.explode(F.sequence(F.floor(F.col(at) / size), F.floor((F.col(at) + window) / size))))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by(at)
        value = kernel(table.column(x).to_numpy().astype(float))
        here = table.column(at).to_numpy() // size == table.column("block_").to_numpy()
        return table.append_column(out, pa.array(value, mask=np.isnan(value))).filter(pa.array(here))

    found = dealt.groupBy("ticker", "block_").applyInArrow(solve, T.StructType([*dealt.schema.fields, T.StructField(out, T.DoubleType())]))
    return found.drop("block_", *([] if number else [at]))


# ---- the same for long series: blocks with a halo instead of one task a ticker -----------------


def permutation_entropy_in_blocks(bars: DataFrame, size: int = SIZE, window: int = WINDOW) -> DataFrame:
    """Log returns and ``permutation_entropy`` of bars."""
    from .returns import log_returns

    return within(bars, lambda x: permutation_entropy(log_returns(x), window=window), window + 2, size=size)


def volume_base_in_blocks(bars: DataFrame, size: int = SIZE, number: str | None = None) -> DataFrame:
    """``volume_base``: the whole series' mean and deviation are aggregates, the trailing year a frame."""
    own = with_totals(bars.withColumn("lv", F.log1p(F.greatest(F.col("volume"), F.lit(0.0)))), lv_mean=F.avg("lv"), lv_sd=F.stddev_samp("lv"))
    score = F.when(F.coalesce("lv_sd", F.lit(0.0)) > 0, (F.col("lv") - F.col("lv_mean")) / nonzero("lv_sd")).otherwise(0.0)
    own = own.withColumn("vol_global_z", score).drop("lv_mean", "lv_sd")
    return within(own, lambda x: x.withColumn("vol_rolling_z", z_score("lv", upto(Z_YEAR))), Z_YEAR, size=size, number=number)


def volume_entropy_in_blocks(bars: DataFrame, size: int = SIZE, window: int = VOLUME_WINDOW, number: str | None = None) -> DataFrame:
    """``volume_entropy``: histogram and sample entropy of the score, a block's kernels in a task."""
    at = number or "number_"
    own = volume_base_in_blocks(bars if number else numbered(bars, at), size, at)
    own = within(own, lambda x: rolling_histogram_entropy(x, "vol_global_z", "vol_shannon", window), window + 1, size=size, number=at)
    own = rolling_sample_entropy_in_blocks(own, "vol_global_z", "vol_sampen", window, 2, r=0.2, least=10, size=size, number=at)
    return own if number else own.drop(at)


def z_global_in_blocks(df: DataFrame, x: str, out: str) -> DataFrame:
    """``z_global`` from aggregates."""
    own = with_totals(df, n_=F.count(x), mean_=F.avg(x), sd_=F.stddev_pop(x))
    return own.withColumn(out, F.when(F.col("n_") < 2, None).when(F.col("sd_") == 0, 0.0).otherwise((F.col(x) - F.col("mean_")) / nonzero("sd_"))).drop("n_", "mean_", "sd_")


def price_features_in_blocks(bars: DataFrame, size: int = SIZE, number: str | None = None) -> DataFrame:
    """``price_features``: frames reach back over the rolling score's window."""
    from .returns import log_returns, moving_average

    def local(x: DataFrame) -> DataFrame:
        return z_rolling(kinematics(permutation_entropy(log_returns(moving_average(x)))), "price_sampen", "spe_z")

    at = number or "number_"
    own = rolling_sample_entropy_in_blocks(bars if number else numbered(bars, at), "close", "price_sampen", PRICE_WINDOW, size=size, number=at)
    own = z_global_in_blocks(within(own, local, Z_LONG, size=size, number=at), "price_sampen", "spe_z_global")
    return own if number else own.drop(at)


def joined_breadth_in_blocks(bars: DataFrame, cse: DataFrame, number: str | None = None) -> DataFrame:
    """``joined_breadth``, carried forward from block to block."""
    at = number or "number_"
    own = (bars if number else numbered(bars, at)).join(cse.withColumnRenamed("cse", "cse_"), "ts", "left")
    return carried_last(own, "cse_", "cse", at).drop("cse_", *([] if number else [at]))

"""Queries over the source tables: one for each operator, and the risk verdict that uses them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import frames as W
from ..functions.blocks import numbered, within
from ..functions.shared import folder, kept, version, written
from ..operators import entropy as E, mixtures as X, regimes as G, returns as R, rules as D, stats as S, table_functions as TF, volatility as V
from ..sources import bars as B, connector as C

#: Parameters of a fixed mixture over (wpe, rv22 / 100), and of a fixed GARCH recursion.
MIXTURE = [
    {"w": 0.3, "mx": 0.84, "my": 4.0, "sxx": 0.004, "sxy": 0.002, "syy": 1.0},
    {"w": 0.4, "mx": 0.90, "my": 4.5, "sxx": 0.002, "sxy": 0.001, "syy": 0.8},
    {"w": 0.3, "mx": 0.94, "my": 5.0, "sxx": 0.001, "sxy": 0.0005, "syy": 1.2},
]
GARCH = {"mu": 0.0, "omega": 20.0, "alpha": 0.1, "beta": 0.8, "start": 900.0}
SLICE = ("1994-01-01", "1996-12-31")
LAMBDA = -0.7
PIVOT = "1996-01-01"
BRANDS = ["Brand#13", "Brand#22"]


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals: engines add in different orders."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def lr(spark, d) -> DataFrame:
    return R.log_returns(B.daily(spark, d))


def wpe(spark, d) -> DataFrame:
    return E.permutation_entropy(R.rolling_volatility(lr(spark, d)))


def labelled(spark, d) -> DataFrame:
    """Bars with forward outcomes and a fixed regime: thirds of wpe."""
    own = R.forward_runup(R.forward_drawdown(R.forward_volatility(wpe(spark, d), 5, 10, 20), 5, 10, 20), 10).where("wpe IS NOT NULL")
    third = F.ntile(3).over(Window.partitionBy("ticker").orderBy(F.round("wpe", 9), "ts")) - 1
    return G.named(own.withColumn("label", third), "label", "regime")


def posteriors(spark, d) -> DataFrame:
    own = wpe(spark, d).where("wpe IS NOT NULL AND rv22 IS NOT NULL")
    return own.select("ticker", "ts", G.posterior(F.col("wpe"), F.col("rv22") / 100, MIXTURE).alias("p"))


def held(spark, d) -> DataFrame:
    return G.hysteresis(posteriors(spark, d), 0.40, 0.20, 3)


# ---- sources ----------------------------------------------------------------------------------


def date_slice(spark, d):
    return r6(R.log_returns(B.between(B.daily(spark, d), *SLICE)).select("ts", "close", "lr"))


def length_guard(spark, d):
    return B.guard(B.by_brand(spark, d), 504)


def source_fallback(spark, d):
    """The first source doesn't exist; rows come from the second."""
    return r6(B.canonical(B.with_fallback(lambda: B.load(spark, f"{d}/no_such_bars.parquet"), lambda: B.daily(spark, d).withColumnsRenamed({"close": " Close", "ts": "Date"}))).select("ticker", "ts", "close", "volume"))


def store(spark, d) -> str:
    """A store of the brands' bars, for the bar source."""
    at = folder(spark, "store")
    C.export_store(B.by_brand(spark, d), at)
    return at


def connector_bars(spark, d):
    """All bars through the bar source; its first root doesn't exist."""
    at = store(spark, d)
    return C.connect(spark, f"{at}/no_such_store", at)


def connector_slice(spark, d):
    """Two brands between dates through the bar source: filters reach it, returns start with the slice."""
    return r6(R.log_returns(C.connect(spark, store(spark, d), tickers=BRANDS, first=SLICE[0], last=SLICE[1])).select("ticker", "ts", "close", "lr"))


def ffill_locf(spark, d):
    own = B.by_segment(spark, d)
    grid = own.select("ticker").distinct().join(own.agg(F.collect_set("ts").alias("days"))).select("ticker", F.explode("days").alias("ts"))
    return r6(grid.join(own.select("ticker", "ts", "close"), ["ticker", "ts"], "left").select("ticker", "ts", W.filled("close").alias("close")))


def basket_returns(spark, d):
    return r6(B.basket_returns(B.by_segment(spark, d)))


def latest_rows(spark, d):
    own = B.by_brand(spark, d)
    at = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    out = own.withColumn("k", F.row_number().over(at)).where("k <= 2").groupBy("ticker").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("last_close"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("previous_close"))
    return r6(out.join(own.groupBy("ticker").agg(F.min_by("close", "ts").alias("first_close")), "ticker"))


# ---- windows ----------------------------------------------------------------------------------


def log_returns(spark, d):
    return r6(lr(spark, d).select("ts", "lr", F.coalesce("lr", F.lit(0.0)).alias("lr0")))


def pct_change(spark, d):
    return r6(R.simple_returns(B.daily(spark, d), 1, 5).select("ts", "ret1", "ret5"))


def sma20(spark, d):
    return r6(R.moving_average(B.daily(spark, d)).select("ts", "sma20", "above_sma20"))


def rolling_vol22(spark, d):
    return r6(R.rolling_volatility(lr(spark, d)).select("ts", "rv22"))


def rolling_minmax(spark, d):
    return r6(B.daily(spark, d).select("ts", W.min_max("volume", W.upto(504), 60).alias("scaled")))


def rolling_median(spark, d):
    return r6(B.daily(spark, d).select("ts", (W.full(F.percentile("close", 0.5).over(W.upto(252)), "close", W.upto(252), 60) + 1e-9).alias("med252")))


def forward_vol(spark, d):
    return r6(R.forward_volatility(lr(spark, d), 5, 10, 20).select("ts", "fv5", "fv10", "fv20"))


def forward_drawdown(spark, d):
    return r6(R.forward_drawdown(B.daily(spark, d), 5, 10, 20).select("ts", "fdd5", "fdd10", "fdd20"))


def forward_runup(spark, d):
    return r6(R.forward_runup(B.daily(spark, d)).select("ts", "runup10"))


def cum_product(spark, d):
    return r6(R.rebased(lr(spark, d)).select("ts", F.round("path", 4).alias("path")))


# ---- entropy ----------------------------------------------------------------------------------


def ordinal_patterns(spark, d):
    own = E.patterns(lr(spark, d)).where("pattern IS NOT NULL")
    return r6(own.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))


def price_wpe_mfi(spark, d):
    return r6(E.permutation_entropy_in_blocks(B.daily(spark, d)).select("ts", "wpe", "complexity", "mfi"))


def brand_wpe(spark, d):
    return r6(E.permutation_entropy(R.log_returns(B.by_brand(spark, d))).select("ticker", "ts", "wpe", "complexity"))


def wpe_order4(spark, d):
    return r6(E.permutation_entropy_any(lr(spark, d), 4, 1, 60).select("ts", "wpe", "complexity"))


def wpe_kinematics(spark, d):
    return r6(E.kinematics(wpe(spark, d)).select("ts", "v_wpe", "a_wpe"))


def sampen(spark, d) -> DataFrame:
    return E.rolling_sample_entropy_in_blocks(B.daily(spark, d), "close", "price_sampen", 60)


def price_sampen(spark, d):
    return r6(sampen(spark, d).select("ts", "price_sampen"))


def spe_z_global(spark, d):
    return r6(E.z_global_in_blocks(sampen(spark, d), "price_sampen", "z").select("ts", "z"))


def spe_z_rolling(spark, d):
    own = within(sampen(spark, d).select("ticker", "ts", "price_sampen"), lambda x: E.z_rolling(x, "price_sampen", "z"), E.Z_LONG)
    return r6(own.select("ts", "z"))


def volume_z(spark, d):
    return r6(E.volume_base_in_blocks(B.daily(spark, d)).select("ts", "lv", "vol_global_z", "vol_rolling_z"))


def volume_sampen(spark, d):
    return r6(E.rolling_sample_entropy_in_blocks(E.volume_base_in_blocks(B.daily(spark, d)), "vol_global_z", "vol_sampen", 60, 2, r=0.2, least=10).select("ts", "vol_sampen"))


def shannon_fixed(spark, d):
    return r6(E.rolling_fixed_bins(E.volume_base(B.daily(spark, d)), "lv", "shannon").select("ts", "shannon"))


def shannon_auto(spark, d):
    return r6(E.rolling_histogram_entropy(E.volume_base(B.daily(spark, d)), "vol_global_z", "shannon").select("ts", "shannon"))


def corr_pairs(spark, d):
    return r6(S.correlations(B.basket_returns(B.by_segment(spark, d)).where("ret IS NOT NULL"), 22).select("ts", "a", "b", "r"))


def corr_entropy_two(spark, d):
    own = S.correlations(B.basket_returns(B.by_segment(spark, d)).where("ret IS NOT NULL"), 22).where("a = 'AUTOMOBILE' AND b = 'BUILDING'")
    return r6(own.select("ts", E.two_asset_entropy(F.col("r"), F.col("flat_a"), F.col("flat_b")).alias("cse")))


def corr_entropy_basket(spark, d):
    return r6(E.correlation_entropy(B.basket_returns(B.by_segment(spark, d))))


# ---- statistics -------------------------------------------------------------------------------


def regime_group_stats(spark, d):
    return r6(S.group_stats(labelled(spark, d), "regime", "fv5", "fv10", "fv20"))


def regime_spread(spark, d):
    return r6(S.spread(labelled(spark, d), "regime", "fv20"))


def kruskal(spark, d):
    return r6(S.kruskal(labelled(spark, d), "regime", "fv20", 5))


def hit_rate_grid(spark, d):
    return r6(S.hit_rates(labelled(spark, d), "regime", ["fdd5", "fdd10", "fdd20"], [-5.0, -10.0, -20.0]))


def lift_contrast(spark, d):
    """Drawdowns in the one extreme regime against those in the other."""
    return r6(S.lift_between(labelled(spark, d), "regime", "Deterministic", "Stochastic", ["fdd5", "fdd10", "fdd20"], [-5.0, -10.0, -20.0]))


def market_lift(spark, d):
    """Each segment as a market: how often a run-up follows in each third of wpe, against the market's own base."""
    own = R.forward_runup(E.permutation_entropy(R.log_returns(B.by_segment(spark, d))), 10)
    third = F.when(F.col("wpe").isNotNull(), F.ntile(3).over(Window.partitionBy("ticker", F.col("wpe").isNull()).orderBy(F.round("wpe", 9), "ts")) - 1)
    return r6(S.lift_by(G.named(own.withColumn("label", third), "label", "regime"), "ticker", "regime", "runup10", [5.0, 20.0, 60.0]))


def lift_table(spark, d):
    return r6(S.lift(labelled(spark, d), "regime", "runup10", 20.0))


def lead_lag(spark, d):
    return r6(S.lead_lag(wpe(spark, d), "wpe", "rv22", 0, 5, 10, 20))


def value_counts(spark, d):
    return labelled(spark, d).groupBy("regime").agg(F.count("*").alias("n"))


def alert_names(spark, d):
    own = labelled(spark, d).withColumn("alert", D.lookup("regime", D.ALERT_NAMES))
    return own.groupBy("alert").agg(F.count("*").alias("n"), F.max((F.col("alert") == "Chaos").cast("int")).alias("is_chaos"))


def ljung_box(spark, d):
    own = lr(spark, d).withColumn("sq", F.col("lr") * F.col("lr") * 100)
    return r6(S.ljung_box(own, "sq", 10).withColumn("lags", F.lit(10)).unionByName(S.ljung_box(own, "sq", 20).withColumn("lags", F.lit(20))))


def forecasts(spark, d) -> DataFrame:
    """Variance of the next bar by two simple forecasts: trailing 22 and 60 bars."""
    own = lr(spark, d)
    for n in (22, 60):
        own = own.withColumn(f"f{n}", W.full(F.var_samp("lr").over(W.before(n)), "lr", W.before(n), n))
    return own.withColumn("rv", F.col("lr") * F.col("lr"))


def qlike_mse(spark, d):
    return r6(S.forecast_scores(forecasts(spark, d), "rv", "f22", "f60"))


def cum_qlike(spark, d):
    return r6(S.cumulative_advantage(forecasts(spark, d), "rv", "f22", "f60").select("ts", "cum_adv"))


def forecast_winner(spark, d):
    own = S.forecast_scores(forecasts(spark, d), "rv", "f22", "f60")
    return r6(own.agg(F.min_by("forecast", "qlike").alias("winner"), ((1 - F.min("qlike") / F.max("qlike")) * 100).alias("improvement_pct")))


def var_es(spark, d):
    return r6(S.tail_risk(lr(spark, d), "lr"))


def market_verdicts(spark, d):
    """Each segment as a market: rank test of forward volatility over thirds of wpe, mean of the lowest and the highest
    third (of five values or more), and the verdict; markets with too little data are kept, as SKIP."""
    bars = B.by_segment(spark, d)
    own = R.forward_volatility(E.permutation_entropy(R.log_returns(bars)), 20).where("wpe IS NOT NULL")
    own = own.withColumn("label", F.ntile(3).over(Window.partitionBy("ticker").orderBy(F.round("wpe", 9), "ts")) - 1).where("fv20 IS NOT NULL")
    groups = own.groupBy("ticker", "label").agg(F.count("*").alias("n"), F.avg("fv20").alias("mean")).where("n >= 5")
    means = groups.groupBy("ticker").agg(*(F.max(F.when(F.col("label") == k, F.col("mean"))).alias(c) for k, c in ((0, "low_wpe"), (2, "high_wpe"))))
    out = bars.select("ticker").distinct().join(means, "ticker", "left").join(S.kruskal(own, "label", "fv20", 5, ("ticker",)), "ticker", "left")
    paradox = F.coalesce(F.col("low_wpe") > F.col("high_wpe"), F.lit(False))
    return r6(out.withColumns({"paradox": paradox, "verdict": D.market_verdict(F.col("k"), F.col("p"), paradox)}))


# ---- models -----------------------------------------------------------------------------------


def gmm_posterior(spark, d):
    own = posteriors(spark, d)
    return r6(own.select("ts", *(F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)), G.top_label(F.col("p")).alias("label")))


def semantic_shares(spark, d):
    """Clusters 0 and 2 as one label: their shares add up."""
    own = posteriors(spark, d).withColumn("q", G.semantic_posterior(F.col("p"), {0: 1, 1: 0, 2: 1}))
    return r6(own.select("ts", F.get("q", F.lit(0)).alias("q0"), F.get("q", F.lit(1)).alias("q1")))


def _params(spark, d) -> DataFrame:
    """(cluster, w, mx, my, sxx, sxy, syy) of the plane (wpe, rv22 / 100), the clusters being thirds of wpe, turned by one."""
    own = labelled(spark, d).where("rv22 IS NOT NULL").select(((F.col("label") + 1) % 3).cast("int").alias("cluster"), F.col("wpe").alias("x"), (F.col("rv22") / 100).alias("y"))
    return G.moments(own, "cluster", "x", "y")


def cluster_semantics(spark, d):
    own = _params(spark, d).withColumn("label", (F.row_number().over(Window.orderBy(F.round(F.col("mx") + F.col("my"), 9))) - 1).cast("int"))
    return G.named(own, "label", "name").select("cluster", "label", "name")


def gmm_ellipse(spark, d):
    own = _params(spark, d)
    return r6(own.select("cluster", *(c.alias(n) for n, c in G.ellipse(*(F.col(n) for n in ("mx", "my", "sxx", "sxy", "syy"))).items())))


def ellipse_polyline(spark, d):
    own = _params(spark, d)
    own = own.select("cluster", *(c.alias(n) for n, c in G.ellipse(*(F.col(n) for n in ("mx", "my", "sxx", "sxy", "syy"))).items()))
    return r6(G.polyline(own).select("cluster", "i", "x", "y"))


def yeo_johnson(spark, d):
    own = E.volume_base(lr(spark, d))
    lam, x = LAMBDA, F.col("lr")
    y = F.when(x >= 0, (F.pow(x + 1, lam) - 1) / lam).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    own = own.withColumn("yj", y)
    z = (F.col("yj") - F.avg("yj").over(W.whole())) / F.stddev_pop("yj").over(W.whole())
    return r6(own.select("ts", "yj", z.alias("yj_z")))


def hysteresis_labels(spark, d):
    return held(spark, d).select("ts", "raw", "held")


def brand_posteriors(spark, d) -> DataFrame:
    own = within(B.by_brand(spark, d), lambda x: E.permutation_entropy(R.rolling_volatility(R.log_returns(x))), 24).where("wpe IS NOT NULL AND rv22 IS NOT NULL")
    return own.select("ticker", "ts", G.posterior(F.col("wpe"), F.col("rv22") / 100, MIXTURE).alias("p"))


def hysteresis_golden(spark, d):
    """The setting of the golden cases (tests) on every brand's posteriors."""
    return G.hysteresis(brand_posteriors(spark, d), 0.40, 0.20, 3).select("ticker", "ts", "held")


def label_diagnostics(spark, d):
    return r6(G.diagnostics(held(spark, d)))


def label_flips(spark, d):
    return r6(G.flips(held(spark, d), "held"))


def regime_islands(spark, d):
    return W.islands(held(spark, d), "held").select("run", "held", "first_ts", "last_ts", "n_bars")


def calibration_rank(spark, d):
    return r6(G.calibration(posteriors(spark, d)))


def calibration_sql(spark, d):
    """The calibration as SQL over the table function: a lot of settings of a series is a task's work."""
    TF.register(spark)
    own = TF.dealt(posteriors(spark, d), G.HARD_GRID, G.SOFT_GRID, G.PERSIST_GRID)
    return r6(G.ranked(spark.sql(f"SELECT * FROM {TF.NAME}(TABLE({{own}}) PARTITION BY (ticker, hard) ORDER BY (ts))", own=own)))


def features(spark, d) -> DataFrame:
    """The whole feature table of the daily bars.  Bars are numbered once; each part is written, since the next reads it
    for its totals and for its rows."""
    bars = written(numbered(B.daily(spark, d), "number"), "bars")
    own = written(E.price_features_in_blocks(bars, number="number"), "price")
    own = written(E.volume_entropy_in_blocks(own, number="number"), "volume")
    returns = written(B.basket_returns(B.by_segment(spark, d)), "returns")
    cse = written(E.correlation_entropy(returns), "breadth")
    return E.joined_breadth_in_blocks(own, cse, "number").drop("number")


def kept_features(spark, d) -> DataFrame:
    """``features`` under the version of the tables that they come from: made once while these stay the same."""
    sources = {t: version(spark, f"{d}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    return kept(spark, "features", {"folder": d, "sources": sources, "windows": [E.WINDOW, E.PRICE_WINDOW, E.VOLUME_WINDOW, E.Z_LONG, E.Z_YEAR]}, lambda: features(spark, d))


def price_regimes(spark, d):
    own = G.mixture_regimes(E.price_features(B.daily(spark, d)), "wpe", "spe_z")
    return r6(G.named(own, "label", "name").select("ts", "label", "name", F.array_max("p").alias("share")))


def volume_regimes(spark, d):
    own = G.mixture_regimes(E.volume_entropy(B.daily(spark, d)), "vol_shannon", "vol_sampen", transformed=True, rounds=100)
    return r6(G.named(own, "label", "name", G.VOLUME_NAMES).select("ts", "label", "name", F.array_max("p").alias("share")))


def dual_regimes(spark, d):
    """The price plane twice: fitted on the rolling score (used for decisions), and on the global score (a stable frame for charts)."""
    own = E.price_features(B.daily(spark, d))
    live = G.named(G.mixture_regimes(own, "wpe", "spe_z"), "label", "name").select("ticker", "ts", "label", "name")
    chart = G.named(G.mixture_regimes(own, "wpe", "spe_z_global"), "label", "name_global").select("ticker", "ts", F.col("label").alias("label_global"), "name_global")
    return live.join(chart, ["ticker", "ts"], "full").select("ts", "label", "name", "label_global", "name_global")


def plane_diagnostics(spark, d):
    """Raw against held labels of the fitted price and volume planes."""
    price = G.mixture_regimes(E.price_features(B.daily(spark, d)), "wpe", "spe_z")
    volume = G.mixture_regimes(E.volume_entropy(B.daily(spark, d)), "vol_shannon", "vol_sampen", transformed=True, rounds=100)
    of = lambda name, own: G.diagnostics(G.hysteresis(own.select("ticker", "ts", "p"))).select(F.lit(name).alias("plane"), "*")
    return r6(of("price", price).unionByName(of("volume", volume)))


def simple_regimes(spark, d):
    """Clusters of features that need no entropy: volatility, five-bar return and log volume; three features, two clusters."""
    own = R.rolling_volatility(R.log_returns(R.simple_returns(B.daily(spark, d), 5))).withColumn("lv", F.log1p("volume"))
    return r6(G.fit_predict(own, ["rv22", "ret5", "lv"], 2, transformed=True, restarts=3).select("ts", "label", F.array_max("p").alias("share")))


def walk_forward(spark, d):
    """Refits side by side; each bar by the model in force."""
    return X.walk_forward(E.permutation_entropy_in_blocks(B.daily(spark, d)), "wpe", "complexity")


def pooled_regimes(spark, d):
    """One mixture of the bars of all brands, fitted by rounds of aggregates."""
    own = within(B.by_brand(spark, d), lambda x: R.rolling_volatility(E.permutation_entropy(R.log_returns(x))), 24)
    own = written(own.select("ticker", "ts", "wpe", (F.col("rv22") / 100).alias("rv")).where("wpe IS NOT NULL AND rv IS NOT NULL"), "brands")
    model = X.pooled_mixture(own, ["wpe", "rv"], 3, restarts=1)
    if model is None:
        return spark.createDataFrame([], "ticker string, ts date, label int, name string, share double")
    return r6(G.named(X.assigned(own, ["wpe", "rv"], model), "label", "name").select("ticker", "ts", "label", "name", F.array_max("p").alias("share")))


def garch_exog(spark, d):
    """The exogenous pair and the returns on complete rows, from stand-ins that SQL has too."""
    own = R.rolling_volatility(E.volume_base(wpe(spark, d))).withColumns({"spe_z": F.col("vol_rolling_z"), "vol_sampen": F.col("complexity"), "vol_shannon": F.col("rv22")})
    return r6(V.exogenous(own).select("ts", "h_price", "h_volume", "pct"))


def garch_variance(spark, d):
    own = lr(spark, d).withColumn("pct", F.col("lr") * 100)
    return r6(V.given_variance(own, **GARCH).select("ts", "cond_vol", "cond_vol_annual"))


def lookahead_gap(spark, d):
    """What bars up to a pivot see of a tripled volume after it: median relative change of the rolling score (none) and of
    the global score (looks ahead by design), over the bars that both series have."""
    bars = B.daily(spark, d)
    one = E.volume_base(bars).select("ts", "vol_rolling_z", "vol_global_z")
    two = E.volume_base(bars.withColumn("volume", F.when(F.col("ts") > F.lit(PIVOT).cast("date"), F.col("volume") * 3).otherwise(F.col("volume")))).select("ts", F.col("vol_rolling_z").alias("z"), F.col("vol_global_z").alias("g"))
    common = one.where((F.col("ts") <= F.lit(PIVOT).cast("date")) & F.col("vol_rolling_z").isNotNull()).select("ts").intersect(two.where("z IS NOT NULL").select("ts"))
    gap = lambda x, y: F.median(F.abs(F.col(x) - F.col(y)) / F.nullif(F.abs(x), F.lit(0.0)))
    return r6(common.join(one, "ts").join(two, "ts").agg(F.count("*").alias("n_common"), gap("vol_rolling_z", "z").alias("rolling_gap"), gap("vol_global_z", "g").alias("global_gap")))


def breadth_ratio(spark, d):
    two = S.correlations(B.basket_returns(B.by_segment(spark, d)).where("ret IS NOT NULL"), 22).where("a = 'AUTOMOBILE' AND b = 'BUILDING'")
    own = two.select(F.lit("ALL").alias("ticker"), "ts", E.two_asset_entropy(F.col("r"), F.col("flat_a"), F.col("flat_b")).alias("cse"))
    return r6(V.breadth_ratio(own).select("ts", "ce_ratio"))


def garch_fit(spark, d):
    return V.garch(V.exogenous(kept_features(spark, d)), "compat", 300)


def garch_x_fit(spark, d):
    return V.garch(V.exogenous(kept_features(spark, d)), "spec", 300)


def rolling_forecast_eval(spark, d):
    """A forecast for each bar after the first window; ``unsettled`` counts the fits that the limit of rounds ended."""
    own = lr(spark, d).withColumn("pct", F.col("lr") * 100)
    found = written(V.rolling_forecasts(own), "forecasts")
    scores = S.forecast_verdict(S.forecast_scores(found, "realised", "garch", "benchmark"), "garch", "benchmark")
    return r6(scores.join(found.groupBy("ticker").agg(F.count_if(~F.col("settled")).alias("unsettled")), "ticker"))


# ---- decisions --------------------------------------------------------------------------------


def decisions(spark, d) -> DataFrame:
    """Each brand's latest bars with a regime and a flow by fixed cuts, as the rules' input."""
    own = E.kinematics(E.permutation_entropy(R.rolling_volatility(E.volume_base(R.moving_average(R.log_returns(B.by_brand(spark, d)))))))
    own = own.where("wpe IS NOT NULL AND rv22 IS NOT NULL").withColumn("sigma", F.round(F.col("rv22") / 400, 4))
    own = own.withColumn("regime", F.when(F.round("wpe", 9) < 0.85, "Deterministic").when(F.round("wpe", 9) < 0.92, "Transitional").otherwise("Stochastic"))
    own = own.withColumn("flow", F.when(F.round("vol_global_z", 9) < -0.5, "Erratic/Noisy Flow").when(F.round("vol_global_z", 9) < 0.5, "Consensus Flow").otherwise("Dispersed Flow"))
    return D.multipliers(own)


def regime_multiplier(spark, d):
    return r6(decisions(spark, d).select("ticker", "ts", "price_mult", "volume_mult", "mult", "mult_source", "sigma_adjusted"))


def verdicts(spark, d):
    own = decisions(spark, d)
    s, g = F.col("sigma_adjusted"), F.col("regime")
    return own.groupBy(D.verdict(s, g).alias("code"), D.verdict(s, g, "spec").alias("spec"), D.zone(s).alias("zone")).agg(F.count("*").alias("n"))


def divergence_alerts(spark, d):
    own = decisions(spark, d)
    return own.groupBy(D.alert(F.col("regime"), F.col("flow"), F.col("vol_global_z"), F.col("sigma_adjusted")).alias("alert")).agg(F.count("*").alias("n"))


def trajectory_class(spark, d):
    own = decisions(spark, d)
    v, a = F.round("v_wpe", 9), F.round("a_wpe", 9)
    return own.groupBy(D.trajectory(v, a).alias("trajectory"), D.trend(v).alias("trend")).agg(F.count("*").alias("n"))


def conclusion_keys(spark, d):
    own = decisions(spark, d)
    return own.groupBy(D.conclusion_key(F.col("regime"), F.round("v_wpe", 9), F.col("above_sma20")).alias("conclusion_key")).agg(F.count("*").alias("n"))


def breadth_labels(spark, d):
    """The breadth of two segments by name."""
    return corr_entropy_two(spark, d).withColumn("label", D.breadth(F.col("cse")))


def risk_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: features, both planes' mixtures, hysteresis, GARCH with entropy, tail, verdict and texts of the latest bar."""
    own = kept_features(spark, d)  # read by both mixtures, the volatility model and the latest row
    price = G.mixture_regimes(own, "wpe", "spe_z")
    calm = G.named(G.hysteresis(price.select("ticker", "ts", "p")), "held", "regime").select("ticker", "ts", "regime")
    volume = G.mixture_regimes(own, "vol_shannon", "vol_sampen", transformed=True, rounds=100)
    flow = G.named(G.hysteresis(volume.select("ticker", "ts", "p")), "held", "flow", G.VOLUME_NAMES).select("ticker", "ts", "flow")
    full = own.join(calm, ["ticker", "ts"], "left").join(flow, ["ticker", "ts"], "left")
    full = full.withColumns({"regime": W.filled("regime"), "flow": W.filled("flow")})
    cols = ["close", "above_sma20", "wpe", "v_wpe", "a_wpe", "spe_z", "vol_global_z", "cse", "regime", "flow"]
    last = full.groupBy("ticker").agg(F.max_by(F.struct("ts", *cols), "ts").alias("x")).select("ticker", "x.*")
    fitted = V.garch(V.exogenous(own), "spec", 300).select("ticker", F.col("sigma_daily_pct").alias("sigma"), "sigma_annual_pct", "delta_h_price", "delta_h_volume", "garch_type", "status", "var_5pct", "es_5pct", "es_5pct_adjusted", "model_quality")
    out = D.multipliers(last.join(fitted, "ticker", "left"))
    s, g = F.col("sigma_adjusted"), F.col("regime")
    out = out.withColumns({
        "verdict": D.verdict(s, g), "verdict_spec": D.verdict(s, g, "spec"), "zone": D.zone(s), "breadth": D.breadth(F.col("cse")), "alert": D.alert(g, F.col("flow"), F.col("vol_global_z"), s),
        "trajectory": D.trajectory(F.col("v_wpe"), F.col("a_wpe")), "conclusion_key": D.conclusion_key(g, F.col("v_wpe"), F.col("above_sma20")),
        "entropy_role": F.when(F.col("garch_type") == "GARCH-X", "ACTIVE").otherwise("DORMANT"),
    })
    return D.paragraphs(D.conclusion(out))


def tool_results_json(spark, d):
    """Results of the metric tools as JSON, one row each; JSON leaves nulls out."""
    own = wpe(spark, d).where("wpe IS NOT NULL")
    last = own.agg(F.max("ts").alias("ts"), F.round(F.max_by("wpe", "ts"), 4).alias("wpe"), F.round(F.max_by("mfi", "ts"), 4).alias("mfi"))
    price = last.select(F.lit("price_metrics").alias("tool"), F.to_json(F.struct(F.lit("success").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "wpe", "mfi")).alias("result"))
    data = B.daily(spark, d).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    data = data.select(F.lit("market_data").alias("tool"), F.to_json(F.struct(F.lit("success").alias("status"), F.col("n").alias("n_bars"), F.date_format("a", "yyyy-MM-dd").alias("first"), F.date_format("b", "yyyy-MM-dd").alias("last"))).alias("result"))
    return data.unionByName(price)


def analysis_frame(spark, d):
    """The feature table, as it is exported."""
    return r6(features(spark, d))


QUERIES = {
    "bars_daily": B.daily, "bars_by_brand": B.by_brand, "bars_by_segment": B.by_segment, "bars_hourly": B.hourly,
} | {f.__name__: f for f in (
    date_slice, length_guard, source_fallback, connector_bars, connector_slice, ffill_locf, basket_returns, latest_rows, log_returns, pct_change, sma20, rolling_vol22, rolling_minmax, rolling_median, forward_vol, forward_drawdown, forward_runup, cum_product,
    ordinal_patterns, price_wpe_mfi, brand_wpe, wpe_order4, wpe_kinematics, price_sampen, spe_z_global, spe_z_rolling, volume_z, volume_sampen, shannon_fixed, shannon_auto, corr_pairs, corr_entropy_two, corr_entropy_basket,
    regime_group_stats, regime_spread, kruskal, hit_rate_grid, lift_table, lift_contrast, market_lift, lead_lag, value_counts, alert_names, ljung_box, qlike_mse, cum_qlike, forecast_winner, var_es, market_verdicts,
    gmm_posterior, semantic_shares, cluster_semantics, gmm_ellipse, ellipse_polyline, yeo_johnson, hysteresis_labels, hysteresis_golden, label_diagnostics, label_flips, regime_islands, calibration_rank, calibration_sql, price_regimes, volume_regimes, dual_regimes, plane_diagnostics, simple_regimes, walk_forward, pooled_regimes,
    garch_exog, garch_variance, lookahead_gap, breadth_ratio, garch_fit, garch_x_fit, rolling_forecast_eval,
    regime_multiplier, verdicts, divergence_alerts, trajectory_class, conclusion_keys, breadth_labels, risk_verdict, tool_results_json, analysis_frame,
)}

"""Property tests of the features and models on synthetic series."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA
from tidemark.functions import frames as W
from tidemark.operators import entropy as E, regimes as G, rules as D, stats as S, volatility as V
from tidemark.sources import bars as B
from tidemark.streaming import ticks as K


def series(spark, x, name="lr"):
    day = datetime.date(2020, 1, 1)
    rows = [("X", day + datetime.timedelta(days=i), None if v is None or math.isnan(v) else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"ticker string, ts date, {name} double")


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def test_noise_is_entropic_and_trend_is_not(spark):
    noise = column(E.permutation_entropy(series(spark, np.random.default_rng(0).standard_normal(500))), "wpe")
    line = column(E.permutation_entropy(series(spark, np.linspace(0.001, 0.010, 200))), "wpe")
    own = [v for v in noise if v is not None]
    assert noise[:22] == [None] * 22 and noise[22] is not None
    assert np.mean(own) > 0.85 and 0 <= min(own) and max(own) <= 1 + 1e-12
    assert np.mean([v for v in line if v is not None]) < 0.15


def test_expressions_equal_arrays(spark):
    x = np.random.default_rng(3).standard_normal(120)
    a = E.permutation_entropy(series(spark, x))
    b = E.permutation_entropy_any(series(spark, x), 3)
    for name in ("wpe", "complexity"):
        assert np.allclose([v for v in column(a, name) if v is not None], [v for v in column(b, name) if v is not None])


def test_rolling_score_does_not_look_ahead(spark):
    x = np.random.default_rng(123).standard_normal(800)
    whole = column(E.z_rolling(series(spark, x, "v"), "v", "z"), "z")
    part = column(E.z_rolling(series(spark, x[:555], "v"), "v", "z"), "z")
    assert whole[:503] == [None] * 503 and abs(whole[554] - part[554]) < 1e-9
    assert abs(whole[700] - (x[700] - x[197:701].mean()) / x[197:701].std(ddof=1)) < 1e-9


def test_global_score_uses_population_deviation(spark):
    z = column(E.z_global(series(spark, [1, 2, 3, 4, 5], "v"), "v", "z"), "z")
    assert np.allclose(z, (np.arange(1, 6) - 3) / np.std([1, 2, 3, 4, 5]))
    assert column(E.z_global(series(spark, [2, None, 2], "v"), "v", "z"), "z") == [0.0, 0.0, 0.0]


def test_sample_entropy_brute_force():
    x = np.random.default_rng(1).standard_normal(40)
    m, r, n = 2, 0.3, 40
    pairs = [(i, j) for i in range(n - m) for j in range(i + 1, n - m)]
    b = sum(all(abs(x[i + k] - x[j + k]) <= r for k in range(m)) for i, j in pairs)
    a = sum(all(abs(x[i + k] - x[j + k]) <= r for k in range(m + 1)) for i, j in pairs)
    assert abs(E.sample_entropy(x, m, r) - -math.log(a / b)) < 1e-12
    assert math.isnan(E.sample_entropy_wrapped(np.ones(30)))


def test_hysteresis_batch_equals_steps(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.6, 0.6, 0.6], 300)
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([("X", day + datetime.timedelta(days=i), v.tolist()) for i, v in enumerate(p)], "ticker string, ts date, p array<double>")
    held, pending, count, want = None, None, 0, []
    for v in p:
        held, pending, count = G.step(held, pending, count, v, 0.4, 0.2, 3)
        want.append(held)
    assert column(G.hysteresis(df, 0.4, 0.2, 3), "held") == want
    grid = G.calibration(df).where("hard = 0.4 AND soft = 0.2 AND persist = 3").first()
    assert grid["held_per_year"] == pytest.approx(sum(a != b for a, b in zip(want, want[1:])) * 252 / 300)
    with pytest.raises(ValueError):
        G.check(0.2, 0.4, 3)


def test_mixture_finds_blobs(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal((0.65, 0.8), 0.05, (50, 2)), rng.normal((0.85, 1.2), 0.05, (50, 2)), rng.normal((0.95, 2.5), 0.05, (50, 2))])
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([("X", day + datetime.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(x)], "ticker string, ts date, a double, b double")
    for transformed in (False, True):
        assert column(G.mixture_regimes(df, "a", "b", transformed, 3, 100), "label") == [0] * 50 + [1] * 50 + [2] * 50


def test_garch_beats_the_truth_in_likelihood():
    rng = np.random.default_rng(7)
    s2, e = 1.0, []
    for _ in range(800):
        e.append(rng.standard_normal() * math.sqrt(s2))
        s2 = 0.05 + 0.1 * e[-1] ** 2 + 0.85 * s2
    r = np.array(e)
    m = V.fit_garch(r)
    true = V.variance_path(r * r, 0.05, 0.1, 0.85)
    assert m["loss"] <= 0.5 * float((np.log(2 * math.pi * true) + r * r / true).sum())
    assert 0 < m["alpha"] + m["beta"] < 1
    var, es = V.tail(m["resid"] / np.sqrt(m["s2"]), 1.0)
    assert es < var < 0


def test_forecasts_and_ljung_box(spark):
    r = np.random.default_rng(2).standard_normal(560)
    out = V.rolling_forecasts(series(spark, r, "pct"), every=40).collect()
    assert len(out) == 2 and all(row["garch"] > 0 for row in out)
    assert sorted(row["benchmark"] for row in out) == pytest.approx(sorted(np.var(r[at - 23 : at - 1], ddof=1) for at in (520, 560)))
    p = S.ljung_box(series(spark, r * r, "sq"), "sq", 10).first()["p"]
    assert p == pytest.approx(S.ljung_box_p(r * r, 10), abs=1e-9)


def test_sources(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Date, Close ,Volume\n2020-01-01,1.0,5\n2020-01-02,,6\n2020-01-03,3.0,\n")
    got = B.load(spark, str(path), "X").orderBy("ts").collect()
    assert [r["close"] for r in got] == [1.0, 1.0, 3.0] and [r["volume"] for r in got] == [5.0, 6.0, 6.0] and got[0]["open"] is None
    with pytest.raises(ValueError):
        B.load(spark, "x.txt")
    runs = W.islands(spark.createDataFrame([("X", i, v) for i, v in enumerate("aabba")], "ticker string, ts int, l string"), "l")
    assert sorted((r["run"], r["l"], r["n_bars"]) for r in runs.collect()) == [(0, "a", 2), (1, "b", 2), (2, "a", 1)]


def test_forecast_query_takes_every_bar(spark, monkeypatch):
    import inspect

    from tidemark.plans import market

    real, steps = V.rolling_forecasts, []

    def seen(*a, **k):
        own = inspect.signature(real).bind(*a, **k)
        own.apply_defaults()
        steps.append(own.arguments["every"])
        return real(*a, **k)

    monkeypatch.setattr(market.V, "rolling_forecasts", seen)
    market.rolling_forecast_eval(spark, DATA)
    assert steps == [1]


def test_forecasts_side_by_side_equal_single_fits():
    rows = np.random.default_rng(3).standard_normal((5, 200)) * np.linspace(0.5, 2, 5)[:, None]
    rows[4] = 0.01  # a constant row
    for own, got in zip(rows, V.forecasts_of(rows, 60)[0]):
        m = V.fit_garch(own, None, 60)
        assert np.isclose(got, m["omega"] + m["alpha"] * m["resid"][-1] ** 2 + m["beta"] * m["s2"][-1], rtol=1e-6)


def test_chi_square_tails():
    # closed forms and table values
    assert S.chi2_tail(2.0, 2) == pytest.approx(math.exp(-1))
    for q, df in ((3.841, 1), (5.991, 2), (7.815, 3), (9.488, 4), (11.070, 5), (18.307, 10)):
        assert S.chi2_tail(q, df) == pytest.approx(0.05, abs=2e-4)


def brute_kruskal(groups):
    values = sorted(v for g in groups for v in g)
    rank = {v: np.mean([i + 1 for i, x in enumerate(values) if x == v]) for v in set(values)}
    n = len(values)
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in g) ** 2 / len(g) for g in groups) - 3 * (n + 1)
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    return h / (1 - ties / (n**3 - n))


def test_kruskal_by_group_with_ties_signs_and_zero(spark):
    rng = np.random.default_rng(4)
    data = {"a": [[round(float(v), 1) for v in rng.normal(m, 1, 30)] for m in (0, 0.3, 1, 1)], "b": [[round(float(v), 1) for v in rng.normal(m, 5, 20)] for m in (0, 2)]}
    rows = [(m, str(g), v) for m, gs in data.items() for g, own in enumerate(gs) for v in own]
    rows += [("c", "0", 1.0), ("c", "0", 2.0), ("d", "0", 3.0), ("d", "1", 3.0), ("a", None, 1.0), ("a", "0", None), ("a", "few", 9.0)]
    df = spark.createDataFrame(rows, "ticker string, g string, x double")
    got = {r["ticker"]: r for r in S.kruskal(df.where("g != 'few' OR g IS NULL"), "g", "x", 1, ("ticker",)).collect()}
    for m, gs in data.items():
        assert got[m]["k"] == len(gs) and got[m]["h"] == pytest.approx(brute_kruskal(gs)) and got[m]["p"] == pytest.approx(S.chi2_tail(brute_kruskal(gs), len(gs) - 1))
    assert got["c"]["h"] is None and got["c"]["p"] is None and got["d"]["h"] is None
    whole = S.kruskal(df.where("ticker = 'a'"), "g", "x", 5).first()
    assert whole["k"] == 4 and whole["h"] == pytest.approx(brute_kruskal(data["a"]))
    assert S.kruskal(df.where("false"), "g", "x", 5, ("ticker",)).count() == 0


def test_market_and_forecast_verdicts(spark):
    rows = [(3, 0.01, True), (3, 0.5, True), (3, 0.01, False), (1, None, True), (None, None, None), (3, None, True)]
    df = spark.createDataFrame(rows, "k long, p double, paradox boolean")
    assert [r[0] for r in df.select(D.market_verdict(F.col("k"), F.col("p"), F.col("paradox"))).collect()] == ["PASS", "PARTIAL", "FAIL", "SKIP", "SKIP", "PARTIAL"]
    scores = spark.createDataFrame([(t, f, q, r) for t, q, r in (("x", 0.5, 0.3), ("y", 0.5, 0.1), ("z", 2.0, 0.9)) for f, q, r in (("m", q, r), ("b", 1.0, 0.0))], "ticker string, forecast string, qlike double, r_sigma double")
    got = {r["ticker"]: (r["verdict"], round(r["improvement_pct"])) for r in S.forecast_verdict(scores, "m", "b").collect()}
    assert got == {"x": ("PASS", 50), "y": ("PARTIAL", 50), "z": ("FAIL", -100)}


def test_clusters_of_any_number_and_features(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(m, 0.05, (40, 3)) for m in (0.0, 1.0, 2.0, 3.0)])
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([("X", day + datetime.timedelta(days=i), *map(float, v)) for i, v in enumerate(x)] + [("Y", day, 1.0, 1.0, 1.0), ("X", day, None, 0.0, 0.0)], "ticker string, ts date, a double, b double, c double")
    got = G.fit_predict(df, ["a", "b", "c"], 4)
    assert column(got, "label") == [k for k in range(4) for _ in range(40)] and len(got.first()["p"]) == 4  # Y has too few rows


def test_walk_forward_refits_by_calendar(spark, monkeypatch):
    x = np.random.default_rng(1).standard_normal((60, 2))
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([("X", day + datetime.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(x)], "ticker string, ts date, a double, b double")
    got = G.walk_forward_regimes(df, "a", "b", days=20, bars=30, least=12).orderBy("ts").collect()
    want, model, fitted = [], None, None
    for i in range(11, 60):
        if model is None or i - fitted >= 20:
            model, fitted = G.fit_mixture(x[max(0, i - 29) : i + 1]), i
        logs = [G.log_density(x[i : i + 1], m, c)[0] + math.log(w) for m, c, w in zip(model["means"], model["covs"], model["weights"])]
        want.append(int(G.semantic_order(model["means"])[int(np.argmax(logs))]))
    assert [r["label"] for r in got] == want


def test_breadth_in_blocks_equals_each_window(spark):
    rng = np.random.default_rng(6)
    day = datetime.date(2020, 1, 1)
    x = rng.standard_normal((60, 4))
    x[:25, 3] = np.nan
    rows = [(day + datetime.timedelta(days=i), f"t{j}", None if math.isnan(v) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    df = spark.createDataFrame(rows, "ts date, ticker string, ret double")
    want = [None if i < 22 else E.eigenvalue_entropy(x[i - 22 : i], 4) for i in range(60)]
    for block in (7, 22, 256):
        got = [r["cse"] for r in E.correlation_entropy(df, block=block).orderBy("ts").collect()]
        assert got[:22] == [None] * 22 and got[22:] == pytest.approx(want[22:])


def test_paragraphs(spark):
    kind = "garch_type string, regime string, above_sma20 boolean, flow string, mult double, sigma double, sigma_annual_pct double, sigma_adjusted double, delta_h_price double, delta_h_volume double, es_5pct double, es_5pct_adjusted double, conclusion_key string"
    df = spark.createDataFrame([
        ("GARCH-X", "Deterministic", True, "Consensus Flow", 2.2, 1.0, 15.9, 2.2, 0.5, -0.1, -2.0, -2.5, "Deterministic/above/other"),
        ("GARCH", "Stochastic", False, "Dispersed Flow", 1.3, 1.0, 15.9, 1.3, 0.0, 0.0, -2.0, None, "Stochastic/falling"),
        (None, None, None, None, 1.0, None, None, None, None, None, None, None, None),
    ], kind)
    for language, word in (("en", "fatter"), ("vi", "dày")):
        a, b, c = D.paragraphs(df, language).collect()
        assert "1.000" in a["volatility_text"] and word in a["tail_text"] and "-2.50" in a["tail_text"] and "2.2" in a["multiplier_text"] and "Dispersed Flow" in b["multiplier_text"]
        assert a["regime_text"] != b["regime_text"] and a["watch_text"] != b["watch_text"] and a["volume_text"] and "{" not in "".join(v for v in (*a, *b) if isinstance(v, str))
        assert [c[f"{n}_text"] is None for n in ("volatility", "regime", "volume", "multiplier", "tail", "watch")] == [False, True, True, True, True, True]
    keys = {k for k in D.PARAGRAPHS if k.startswith("watch/")}
    assert {f"watch/{k.rsplit('/', 1)[-1]}" for k in D.TEXTS} == keys


def test_conclusions_in_vietnamese(spark):
    df = spark.createDataFrame([(k, 1.5) for k in D.TEXTS], "conclusion_key string, sigma_adjusted double")
    got = {r["conclusion_key"]: r["conclusion"] for r in D.conclusion(df, language="vi").collect()}
    assert got == {k: v[1].replace("{s}", "1.50") for k, v in D.TEXTS.items()}


def test_export_and_refit_of_batches(spark, tmp_path):
    bars = B.daily(spark, DATA).limit(50)
    B.export_csv(bars, str(tmp_path / "x.csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "x.csv"))
    assert back.columns == bars.columns and back.count() == 50
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).withColumn("x", F.col("id").cast("double")).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    seen = {}
    stream = K.tick_stream(spark, str(tmp_path / "feed"), "id bigint, x double")
    K.refit_each_batch(stream, lambda batch, n: seen.setdefault(n, batch.agg(F.avg("x")).first()[0]), str(tmp_path / "state")).awaitTermination()
    assert seen == {0: 4.5, 1: 14.5, 2: 24.5}


def test_fallback_is_for_sources_only(spark):
    other = lambda: spark.range(1)
    assert B.with_fallback(lambda: spark.read.parquet("/nowhere/at/all"), other).count() == 1 and B.with_fallback(lambda: spark.range(0), other).count() == 1
    with pytest.raises(ZeroDivisionError):
        B.with_fallback(lambda: 1 / 0, other)
    with pytest.raises(ValueError):
        B.with_fallback(lambda: spark.range(0))


def test_lifts_without_rows_or_hits(spark):
    from tidemark.operators import stats as S

    df = spark.createDataFrame([("M", "a", -6.0), ("M", "a", -1.0), ("M", "b", -1.0), ("M", None, -9.0), ("M", "a", None), ("N", "b", 0.0)], "market string, g string, x double")
    rows = {(r["threshold"]): tuple(r)[2:] for r in S.lift_between(df, "g", "a", "b", ["x"], [-5.0, -0.5]).collect()}
    assert rows == {-5.0: (2, 2, 0.5, 0.0, 0.0), -0.5: (2, 2, 1.0, 0.5, 2.0)}
    none = S.lift_between(df.where("false"), "g", "a", "b", ["x"], [-5.0]).collect()
    assert [tuple(r)[2:] for r in none] == [(0, 0, 0.0, 0.0, 0.0)]
    by = {(r["market"], r["g"]): (r["n"], r["rate"], r["base_rate"], r["lift"]) for r in S.lift_by(df, "market", "g", "x", [-2.0, ]).collect()}
    assert by == {("M", "a"): (2, 0.5, 0.5, 1.0), ("M", "b"): (1, 1.0, 0.5, 2.0), ("N", "b"): (1, 1.0, 1.0, 1.0)}
    assert S.lift_by(df, "market", "g", "x", [5.0]).where("lift IS NOT NULL").isEmpty()

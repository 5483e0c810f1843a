"""Robust errors of the variance model, the pruning of its columns, and forecasts run until they settle."""

import datetime
import math

import numpy as np
import pytest

from tidemark.operators import volatility as V

DAY = datetime.date(2001, 1, 1)


def simulated(n, deltas, seed, tails=None):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(deltas)))
    z = rng.standard_t(tails, n) * math.sqrt((tails - 2) / tails) if tails else rng.standard_normal(n)
    s2, e = 1.0, np.empty(n)
    for t in range(n):
        e[t] = math.sqrt(s2) * z[t]
        s2 = 0.1 + 0.1 * e[t] ** 2 + 0.6 * s2 + float(x[t] @ deltas)
    # a bar's column is the one that its variance was made of
    return e, np.vstack([np.zeros(len(deltas)), x[:-1]])


def test_errors_equal_those_of_a_mean():
    """The sandwich of a normal mean is its usual error, also where the assumed variance is wrong."""
    x = np.random.default_rng(1).standard_normal(4000) * 3
    got = V.robust_errors(lambda p: 0.5 * (x - p[0]) ** 2, np.array([x.mean()]))
    assert got[0] == pytest.approx(x.std() / math.sqrt(len(x)), rel=1e-4)


def test_coverage_without_an_effect():
    """Columns without effect, heavy-tailed shocks: p-values under 0.10 come about as often as they should."""
    small = []
    for seed in range(24):
        e, x = simulated(500, np.array([0.0]), seed, tails=6)
        small += [p < 0.10 for p in V.fit_garch(e, x, 300)["pvalues"]]
    assert sum(small) <= 7


def test_an_effect_is_found():
    e, x = simulated(1500, np.array([3.0]), 5)
    m = V.fit_garch(e, x, 400)
    assert m["pvalues"][0] < 0.01 and m["errors"][4] > 0 and abs(m["delta"][0] - 3.0) < 4 * m["errors"][4]
    assert V.fit_garch(e, x, 400, "ratio")["pvalues"][0] < 0.01
    with pytest.raises(ValueError):
        V.fit_garch(e, x, 10, "none")


@pytest.mark.parametrize("deltas, used", [((3.0, 3.0), ["H_price", "H_volume"]), ((3.0, 0.0), ["H_price"]), ((0.0, 3.0), ["H_volume"]), ((0.0, 0.0), [])])
def test_every_branch_of_the_pruning(spark, deltas, used):
    e, x = simulated(1500, np.array(deltas), 4)
    rows = [("T", DAY + datetime.timedelta(days=k), float(v), float(a), float(b)) for k, (v, (a, b)) in enumerate(zip(e, x))]
    out = V.garch(spark.createDataFrame(rows, "ticker string, ts date, pct double, h_price double, h_volume double"), "spec", 400).first()
    assert out["status"] == "success" and out["exog_vars_used"] == used and out["garch_type"] == ("GARCH-X" if used else "GARCH")
    assert (out["delta_h_price"] != 0) == ("H_price" in used) and (out["pval_h_volume"] <= 0.1) == ("H_volume" in used)


def test_forecasts_settle_and_blocks_agree(spark):
    r = np.random.default_rng(2).standard_normal(420)
    df = spark.createDataFrame([("T", DAY + datetime.timedelta(days=k), float(v)) for k, v in enumerate(r)], "ticker string, ts date, pct double")
    one, many = ({x["ts"]: (x["garch"], x["settled"]) for x in V.rolling_forecasts(df, window=200, size=size).collect()} for size in (4096, 50))
    assert len(one) == 220 and one.keys() == many.keys() and all(s for _, s in one.values())
    assert all(math.isclose(one[k][0], many[k][0], rel_tol=1e-9) for k in one)
    ended = V.forecasts_of(np.lib.stride_tricks.sliding_window_view(r, 200)[:20], 5)
    assert not ended[1].any() and np.isfinite(ended[0]).all()

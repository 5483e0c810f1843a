"""Conditional volatility: GARCH(1,1) with lagged entropy, filtered historical simulation, forecasts.

``spec`` puts the exogenous pair in the variance equation, as the model is documented:
s2[t] = omega + alpha * e[t-1]^2 + beta * s2[t-1] + d1 * H_price[t-1] + d2 * H_volume[t-1].
``compat`` leaves it out, which is what a constant-mean fit with ignored regressors gives.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.blocks import affine_scan, numbered
from ..functions.frames import YEAR, full, min_max, upto, w
from .stats import ljung_box_p

LEAST_BARS, LONG, LEAST = 120, 504, 60
ALPHA = 0.10
DRAWS = 10_000
#: Windows that are fitted side by side, and the rounds after which a search that hasn't settled is ended.
LANES, ROUNDS = 256, 2000


def exogenous(df: DataFrame) -> DataFrame:
    """Complete rows with ``h_price``, ``h_volume`` (trailing min-max, a bar late) and ``pct`` (percent log return between rows)."""
    need = ["wpe", "spe_z", "vol_sampen", "vol_shannon", "close"]
    own = df.na.drop(subset=need)
    own = own.withColumns({"hp": (F.col("wpe") + F.abs("spe_z")) / 2, "hv": (F.col("vol_sampen") + F.col("vol_shannon")) / 2})
    own = own.withColumns({"sp": min_max("hp", upto(LONG), LEAST), "sv": min_max("hv", upto(LONG), LEAST)})
    own = own.withColumns({"h_price": F.lag("sp").over(w()), "h_volume": F.lag("sv").over(w())}).na.drop(subset=["h_price", "h_volume"])
    ratio = F.col("close") / F.lag("close").over(w())
    return own.withColumn("pct", F.when(ratio > 0, F.ln(ratio) * 100)).drop("hp", "hv", "sp", "sv")


def variance_path(e2: np.ndarray, omega, alpha, beta, extra=0.0) -> np.ndarray:
    decay = 0.94 ** np.arange(min(75, len(e2)))
    s2 = float((e2[: len(decay)] * decay).sum() / decay.sum())
    before, out = s2, []
    own = [before, *e2.tolist()]
    more = np.broadcast_to(np.asarray(extra, float), len(e2)).tolist()
    for e, x in zip(own, more):
        s2 = max(omega + alpha * e + beta * s2 + x, 1e-12)
        out.append(s2)
    return np.array(out)


def nelder_mead(f, start: np.ndarray, rounds: int = 500, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    n = len(start)
    points = np.vstack([start, *(start + np.eye(n)[i] * (0.25 if start[i] == 0 else 0.1 * abs(start[i]) + 0.1) for i in range(n))])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if values[-1] - values[0] < tolerance * (abs(values[0]) + tolerance):
            break
        centre = points[:-1].mean(axis=0)
        far = centre + (centre - points[-1])
        v = f(far)
        if v < values[0]:
            more = centre + 2 * (centre - points[-1])
            u = f(more)
            points[-1], values[-1] = (more, u) if u < v else (far, v)
        elif v < values[-2]:
            points[-1], values[-1] = far, v
        else:
            near = centre + 0.5 * ((far if v < values[-1] else points[-1]) - centre)
            u = f(near)
            if u < min(v, values[-1]):
                points[-1], values[-1] = near, u
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    best = int(values.argmin())
    return points[best], float(values[best])


def robust_errors(each, theta: np.ndarray) -> np.ndarray:
    """Standard errors of estimates by quasi maximum likelihood, whatever the shocks' distribution: the sandwich
    H^-1 G H^-1 of the Hessian of the summed losses and the outer products of each bar's score.

    ``each`` gives the loss of every bar at parameters; derivatives are central differences.  NaN where the
    Hessian does not determine a parameter (one on the edge of its range)."""
    k = len(theta)
    h = 1e-4 * np.maximum(np.abs(theta), 1e-2)
    at = lambda *moves: each(theta + sum((s * h[i] * np.eye(k)[i] for i, s in moves), np.zeros(k)))
    up, down, mid = [at((i, 1)) for i in range(k)], [at((i, -1)) for i in range(k)], float(at().sum())
    scores = np.stack([(u - d) / (2 * g) for u, d, g in zip(up, down, h)], axis=1)
    hess = np.empty((k, k))
    for i in range(k):
        hess[i, i] = (up[i].sum() - 2 * mid + down[i].sum()) / h[i] ** 2
        for j in range(i):
            hess[i, j] = hess[j, i] = (at((i, 1), (j, 1)).sum() - at((i, 1), (j, -1)).sum() - at((i, -1), (j, 1)).sum() + at((i, -1), (j, -1)).sum()) / (4 * h[i] * h[j])
    if not np.isfinite(hess).all() or not np.isfinite(scores).all():
        return np.full(k, np.nan)
    bread = np.linalg.pinv(hess, rcond=1e-12, hermitian=True)
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.diag(bread @ (scores.T @ scores) @ bread))


def fit_garch(r: np.ndarray, exog: np.ndarray | None = None, rounds: int = 500, test: str = "robust") -> dict:
    """Normal maximum likelihood; parameters mu, omega, alpha, beta and one delta for each column of ``exog``.

    p-values of the deltas come from robust standard errors, or with ``test="ratio"`` from likelihood ratios; an
    error that cannot be told gives a p-value of 1."""
    if test not in ("robust", "ratio"):
        raise ValueError(f"no such test: {test}")
    k = 0 if exog is None else exog.shape[1]
    var = max(float(r.var()), 1e-8)

    def natural(p):
        a, b = 1 / (1 + math.exp(-p[2])), 1 / (1 + math.exp(-p[3]))
        return p[0], math.exp(min(p[1], 50.0)), 0.999 * a * (1 - b), 0.999 * b, p[4:]

    def path(p):
        mu, omega, alpha, beta, delta = natural(p)
        e = r - mu
        return e, variance_path(e * e, omega, alpha, beta, exog @ delta if k else 0.0)

    def loss(p):
        e, s2 = path(p)
        v = 0.5 * float((np.log(2 * math.pi * s2) + e * e / s2).sum())
        return v if math.isfinite(v) else 1e12

    best = None
    for b in (2.2, 0.5):
        start = np.array([r.mean(), math.log(var * 0.1), -1.0, b, *[0.0] * k])
        p, v = nelder_mead(loss, start, rounds)
        if best is None or v < best[1]:
            best = (p, v)
    p, v = best
    mu, omega, alpha, beta, delta = natural(p)
    e, s2 = path(p)
    pvalues, errors = [], np.full(4 + k, np.nan)
    if k and test == "robust":
        def each(theta):
            gap = r - theta[0]
            v = variance_path(gap * gap, *theta[1:4], exog @ theta[4:])
            return 0.5 * (np.log(2 * math.pi * v) + gap * gap / v)

        with np.errstate(all="ignore"):
            errors = robust_errors(each, np.array([mu, omega, alpha, beta, *delta]))
        pvalues = [math.erfc(abs(d) / se / math.sqrt(2)) if se > 0 else 1.0 for d, se in zip(delta, errors[4:])]
    elif k:
        for j in range(k):  # against the model without the column
            rest = np.delete(exog, j, axis=1)
            less = fit_garch(r, rest if k > 1 else None, rounds // 2, "ratio")["loss"]
            pvalues.append(math.erfc(math.sqrt(max(0.0, less - v))))
    n = 4 + k
    return {"mu": mu, "omega": omega, "alpha": alpha, "beta": beta, "delta": delta, "pvalues": pvalues, "errors": errors, "resid": e, "s2": s2, "loss": v, "aic": 2 * n + 2 * v, "bic": n * math.log(len(r)) + 2 * v}


def tail(z: np.ndarray, sigma_next: float, draws: int = DRAWS, seed: int = 42) -> tuple[float, float]:
    """VaR and ES at 5 % of returns resampled from standardised residuals, as fractions."""
    sim = np.random.default_rng(seed).choice(z, size=draws, replace=True) * sigma_next / 100
    var = float(np.quantile(sim, 0.05))
    low = sim[sim < var]
    return var, float(low.mean()) if len(low) else var


RESULT = (
    "ticker string, status string, garch_type string, latest_date string, sigma_daily_pct double, sigma_annual_pct double, h_price_today double, h_volume_today double, "
    "delta_h_price double, delta_h_volume double, var_5pct double, es_5pct double, lb_pval_lag10 double, lb_pval_lag20 double, model_quality string, warning string, "
    "log_likelihood double, aic double, bic double, n_obs bigint, alpha_plus_beta double, pval_h_price double, pval_h_volume double, exog_vars_used array<string>, "
    "es_5pct_adjusted double, cross_entropy_ratio double, params struct<mu:double,omega:double,alpha:double,beta:double>"
)


def garch(df: DataFrame, mode: str = "spec", rounds: int = 500, test: str = "robust") -> DataFrame:
    """A row for each ticker from ``exogenous`` rows (``cse`` is used where there): the fitted model and its tail.

    Columns with a p-value above 0.10 are dropped and the rest refitted; failures give a row with their status."""
    names = ["H_price", "H_volume"]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        out = dict.fromkeys([f.split()[0] for f in RESULT.split("struct<")[0].split(", ")][:-1]) | {"ticker": frame["ticker"].iloc[0], "params": None}
        own = frame[frame["pct"].notna()]
        r = own["pct"].to_numpy(float)
        if len(r) < LEAST_BARS - 1:
            return pd.DataFrame([out | {"status": "too few complete rows"}])
        try:
            exog = own[["h_price", "h_volume"]].to_numpy(float) if mode == "spec" else None
            used, m = names, fit_garch(r, exog, rounds, test)
            if exog is not None:
                kept = [j for j, p in enumerate(m["pvalues"]) if p <= ALPHA]
                if len(kept) < 2:
                    used = [names[j] for j in kept]
                    m = fit_garch(r, exog[:, kept] if kept else None, rounds, test)
            else:
                used = []
        except (ValueError, np.linalg.LinAlgError, OverflowError) as e:
            return pd.DataFrame([out | {"status": f"fit failed: {e}"}])
        sigma = np.sqrt(m["s2"])
        z = m["resid"] / sigma
        delta, p = dict(zip(used, m["delta"])), dict(zip(used, m["pvalues"]))
        extra = sum(delta.get(n, 0.0) * own[c].iloc[-1] for n, c in zip(names, ("h_price", "h_volume")))
        ahead = math.sqrt(max(m["omega"] + m["alpha"] * m["resid"][-1] ** 2 + m["beta"] * m["s2"][-1] + extra, 1e-12))
        var, es = tail(z, ahead)
        lb = [ljung_box_p(z * z, k) for k in (10, 20)]
        both = m["alpha"] + m["beta"]
        out |= {
            "status": "success", "garch_type": "GARCH-X" if used else "GARCH", "latest_date": str(own["ts"].iloc[-1])[:10], "sigma_daily_pct": round(float(sigma[-1]), 4), "sigma_annual_pct": round(float(sigma[-1]) * math.sqrt(YEAR), 4),
            "h_price_today": round(float(own["h_price"].iloc[-1]), 4), "h_volume_today": round(float(own["h_volume"].iloc[-1]), 4), "delta_h_price": round(float(delta.get("H_price", 0.0)), 6), "delta_h_volume": round(float(delta.get("H_volume", 0.0)), 6),
            "var_5pct": round(var * 100, 4), "es_5pct": round(es * 100, 4), "lb_pval_lag10": round(lb[0], 4), "lb_pval_lag20": round(lb[1], 4), "model_quality": "residual_autocorrelation" if min(lb) < 0.05 else "good",
            "warning": "IGARCH_detected" if both >= 0.999 else None, "log_likelihood": round(-m["loss"], 2), "aic": round(m["aic"], 2), "bic": round(m["bic"], 2), "n_obs": len(r), "alpha_plus_beta": round(both, 4),
            "pval_h_price": round(float(p.get("H_price", 1.0)), 4), "pval_h_volume": round(float(p.get("H_volume", 1.0)), 4), "exog_vars_used": used, "params": {k: float(m[k]) for k in ("mu", "omega", "alpha", "beta")},
        }
        if "cse" in own and own["cse"].notna().any():
            series = own["cse"]
            mid = series.rolling(252, min_periods=60).median().iloc[-1]
            if not (math.isnan(series.iloc[-1]) or math.isnan(mid)):
                ratio = min(1.5, max(0.8, series.iloc[-1] / mid if mid > 0 else 1.0))
                out |= {"cross_entropy_ratio": round(ratio, 4), "es_5pct_adjusted": round(es * ratio * 100, 4)}
        return pd.DataFrame([out])

    cols = ["ticker", "ts", "pct", "h_price", "h_volume", *(["cse"] if "cse" in df.columns else [])]
    return df.select(*cols).groupBy("ticker").applyInPandas(one, RESULT)


def given_variance(df: DataFrame, mu: float, omega: float, alpha: float, beta: float, start: float) -> DataFrame:
    """(ticker, ts, cond_vol, cond_vol_annual) of returns ``pct`` under given parameters, the first variance being ``start``.

    The recursion s2[t+1] = beta s2[t] + omega + alpha (pct[t] - mu)^2 is affine in s2: a scan in blocks, as expressions."""
    rows = numbered(df.where(F.col("pct").isNotNull()).select("ticker", "ts", "pct"))
    shock = omega + alpha * (F.col("pct") - mu) * (F.col("pct") - mu)
    out = affine_scan(rows, F.lit(float(beta)), shock, start, "s2").select("ticker", "ts", F.sqrt("s2").alias("cond_vol"))
    return out.withColumn("cond_vol_annual", F.col("cond_vol") * math.sqrt(YEAR))


def forecasts_of(r: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Variance a bar ahead of each row of returns, by the same likelihood, starts and simplex steps as
    ``fit_garch``, with all rows as lanes of one search, each until its simplex has settled; a row that cannot be
    fitted gives NaN.  And whether the better of its two searches settled within ``rounds``."""
    lanes, n = r.shape
    x = np.ascontiguousarray(r.T)
    var = np.maximum(r.var(axis=1), 1e-8)
    decay = 0.94 ** np.arange(min(75, n))

    def natural(p):
        a, b = 1 / (1 + np.exp(-p[2])), 1 / (1 + np.exp(-p[3]))
        return p[0], np.exp(np.minimum(p[1], 50.0)), 0.999 * a * (1 - b), 0.999 * b

    def path(p, own):
        mu, omega, alpha, beta = natural(p)
        e2 = (x[:, own] - mu) ** 2
        s2 = np.empty_like(e2)
        last = (e2[: len(decay)] * decay[:, None]).sum(axis=0) / decay.sum()
        push = alpha * last
        for t in range(n):
            last = np.maximum(omega + push + beta * last, 1e-12)
            s2[t] = last
            push = alpha * e2[t]
        return e2, s2, omega + push + beta * last

    def loss(p, own):
        with np.errstate(all="ignore"):
            e2, s2, _ = path(p, own)
            v = 0.5 * (np.log(2 * math.pi * s2) + e2 / s2).sum(axis=0)
        return np.where(np.isfinite(v), v, 1e12)

    def search(start):
        own = np.arange(lanes)
        points = np.repeat(start[None], 5, axis=0)  # point, parameter, lane
        for i in range(4):
            points[i + 1, i] += np.where(start[i] == 0, 0.25, 0.1 * np.abs(start[i]) + 0.1)
        values = np.stack([loss(q, own) for q in points])
        result, least, settled = start.copy(), np.full(lanes, np.inf), np.ones(lanes, bool)
        for _ in range(rounds):
            order = np.argsort(values, axis=0, kind="stable")
            values = np.take_along_axis(values, order, axis=0)
            points = np.take_along_axis(points, order[:, None, :], axis=0)
            done = values[-1] - values[0] < 1e-7 * (np.abs(values[0]) + 1e-7)
            if done.any():
                result[:, own[done]], least[own[done]] = points[0][:, done], values[0][done]
                own, points, values = own[~done], points[:, :, ~done], values[:, ~done]
            if not len(own):
                return result, least, settled
            centre, worst = points[:-1].mean(axis=0), points[-1].copy()
            far = centre + (centre - worst)
            v = loss(far, own)
            grow, keep = v < values[0], (v >= values[0]) & (v < values[-2])
            inner = np.where(v < values[-1], far, worst)
            other = np.where(grow, centre + 2 * (centre - worst), centre + 0.5 * (inner - centre))
            u = np.full(len(own), np.inf)
            ask = np.flatnonzero(~keep)
            if len(ask):
                u[ask] = loss(other[:, ask], own[ask])
            second = (grow & (u < v)) | (~grow & ~keep & (u < np.minimum(v, values[-1])))
            first = (grow | keep) & ~second
            points[-1] = np.where(second, other, np.where(first, far, worst))
            values[-1] = np.where(second, u, np.where(first, v, values[-1]))
            shrink = np.flatnonzero(~second & ~first)
            if len(shrink):
                for i in range(1, 5):
                    points[i][:, shrink] = points[0][:, shrink] + 0.5 * (points[i][:, shrink] - points[0][:, shrink])
                    values[i, shrink] = loss(points[i][:, shrink], own[shrink])
        best = values.argmin(axis=0)
        result[:, own], least[own], settled[own] = points[best, :, np.arange(len(own))].T, values[best, np.arange(len(own))], False
        return result, least, settled

    found = [search(np.stack([r.mean(axis=1), np.log(var * 0.1), np.full(lanes, -1.0), np.full(lanes, b)])) for b in (2.2, 0.5)]
    second = found[1][1] < found[0][1]
    p = np.where(second, found[1][0], found[0][0])
    with np.errstate(all="ignore"):
        return path(p, np.arange(lanes))[2], np.where(second, found[1][2], found[0][2])


def breadth_ratio(df: DataFrame) -> DataFrame:
    """``ce_ratio``: breadth against its trailing median (252 bars, 60 at least), clipped to [0.8, 1.5]."""
    mid = full(F.percentile("cse", 0.5).over(upto(252)), "cse", upto(252), 60)
    ratio = F.when(mid > 0, F.col("cse") / mid).otherwise(F.when(mid.isNotNull(), 1.0))
    return df.withColumn("ce_ratio", F.when(F.col("cse").isNotNull() & ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.8)), F.lit(1.5))))


def rolling_forecasts(df: DataFrame, window: int = LONG, every: int = 1, rounds: int = ROUNDS, size: int = LANES) -> DataFrame:
    """(ticker, ts, realised, garch, benchmark, settled): variance a bar ahead from the ``window`` returns before, against
    the squared return; ``settled`` is false where the search was ended by ``rounds``.

    Bars are dealt into blocks of ``size`` with the ``window`` bars before them; windows slide inside a block, whose
    fits are lanes of one search.  A fit that fails gives no row."""
    rows = numbered(df.where(F.col("pct").isNotNull()).select("ticker", "ts", "pct"))
    block = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + window) / size)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        at, x = frame["at"].to_numpy(), frame["pct"].to_numpy(float)
        last = np.flatnonzero((at // size == frame["block"].to_numpy()) & (at >= window) & ((at + 1) % every == 0))
        if not len(last):
            return frame.iloc[:0].assign(realised=0.0, garch=0.0, benchmark=0.0, settled=True)[NAMES]
        own = np.lib.stride_tricks.sliding_window_view(x, window)[last - window]
        ahead, settled, fit = np.full(len(last), np.nan), np.zeros(len(last), bool), np.isfinite(own).all(axis=1)
        if fit.any():
            ahead[fit], settled[fit] = forecasts_of(own[fit], rounds)
        out = frame.iloc[last].assign(realised=x[last] ** 2, garch=ahead, benchmark=own[:, -22:].var(axis=1, ddof=1), settled=settled)
        return out[np.isfinite(ahead)][NAMES]

    NAMES = ["ticker", "ts", "realised", "garch", "benchmark", "settled"]
    kind = df.schema["ts"].dataType.simpleString()
    return rows.withColumn("block", block).groupBy("ticker", "block").applyInPandas(solve, f"ticker string, ts {kind}, realised double, garch double, benchmark double, settled boolean")

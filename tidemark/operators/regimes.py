"""Regimes: Gaussian mixtures of two planes, their semantics, and hysteresis against flicker."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import YEAR, w
from . import trigger

#: Names by semantic label (fixed values).
PRICE_NAMES = {0: "Deterministic", 1: "Transitional", 2: "Stochastic"}
VOLUME_NAMES = {0: "Consensus Flow", 1: "Dispersed Flow", 2: "Erratic/Noisy Flow"}
HARD, SOFT, PERSIST = 0.60, 0.35, 8
HARD_GRID, SOFT_GRID, PERSIST_GRID = (0.30, 0.40, 0.50, 0.60), (0.15, 0.20, 0.25, 0.30, 0.35), (3, 5, 8, 13, 21)
FLIPS_LOW, FLIPS_HIGH = 4.0, 10.0
REFIT_DAYS, REFIT_BARS = 21, 504


def named(df: DataFrame, label: str, out: str, names: dict[int, str] = PRICE_NAMES, default: str = "Unknown") -> DataFrame:
    mapping = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return df.withColumn(out, F.when(F.col(label).isNotNull(), F.coalesce(F.try_element_at(mapping, F.col(label).cast("int")), F.lit(default))))


# ---- mixtures ---------------------------------------------------------------------------------


def log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (x - mean).T)
    return -0.5 * ((z * z).sum(axis=0) + len(mean) * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()


def fit_mixture(x: np.ndarray, k: int = 3, restarts: int = 10, rounds: int = 500, seed: int = 42, ridge: float = 1e-6, tolerance: float = 1e-3) -> dict:
    """Expectation maximisation with full covariances; the best of several k-means++ starts."""
    rng, best = np.random.default_rng(seed), None
    n, d = x.shape
    for _ in range(restarts):
        centres = x[rng.integers(n)][None]
        while len(centres) < k:
            gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, x[rng.choice(n, p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(n)]])
        for _ in range(20):
            own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
        share = np.eye(k)[own]
        last = -math.inf
        for _ in range(rounds):
            weight = share.sum(axis=0) + 1e-10
            means = share.T @ x / weight[:, None]
            covs = [((share[:, j, None] * (x - means[j])).T @ (x - means[j])) / weight[j] + ridge * np.eye(d) for j in range(k)]
            logs = np.stack([log_density(x, means[j], covs[j]) + math.log(weight[j] / n) for j in range(k)], axis=1)
            top = logs.max(axis=1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
            share, now = np.exp(logs - norm[:, None]), norm.mean()
            if abs(now - last) < tolerance:
                break
            last = now
        if best is None or now > best["fit"]:
            best = {"weights": weight / n, "means": means, "covs": np.array(covs), "fit": now, "share": share}
    return best


def semantic_order(means: np.ndarray) -> np.ndarray:
    """Label of each cluster: rank of the sum of its centre."""
    rank = np.empty(len(means), int)
    rank[np.argsort(means.sum(axis=1), kind="stable")] = np.arange(len(means))
    return rank


def power_transform(x: np.ndarray, lam: float) -> np.ndarray:
    """Yeo-Johnson."""
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def power_lambda(x: np.ndarray) -> float:
    """The exponent of greatest likelihood, by golden section."""
    jac = (np.sign(x) * np.log1p(np.abs(x))).sum()
    cost = lambda lam: len(x) / 2 * math.log(max(power_transform(x, lam).var(), 1e-300)) - (lam - 1) * jac
    a, b, g = -5.0, 5.0, (math.sqrt(5) - 1) / 2
    while b - a > 1e-6:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if cost(c) < cost(d) else (c, b)
    return (a + b) / 2


def fit_predict(df: DataFrame, features: list[str], k: int = 3, transformed: bool = False, restarts: int = 10, rounds: int = 500) -> DataFrame:
    """(ticker, ts, features, label, p): a mixture of ``k`` clusters for each ticker on its complete rows; p by semantic label.

    With ``transformed`` the features go through Yeo-Johnson and are standardised first, and labels rank the
    clusters' means of the features as they were.  Fewer than 10 rows, or than ``k``, give nothing."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        raw = frame[features].to_numpy(float)
        if len(raw) < max(10, k):
            return frame.iloc[:0].assign(label=pd.Series(dtype="int32"), p=pd.Series(dtype=object))
        own = raw
        if transformed:
            own = np.column_stack([power_transform(c, power_lambda(c)) for c in raw.T])
            own = (own - own.mean(axis=0)) / np.where(own.std(axis=0) > 0, own.std(axis=0), 1)
        model = fit_mixture(own, k, restarts, rounds)
        hard = model["share"].argmax(axis=1)
        centre = np.array([raw[hard == j].mean(axis=0) if (hard == j).any() else np.full(len(features), np.inf) for j in range(k)]) if transformed else model["means"]
        rank = semantic_order(centre)
        p = model["share"][:, np.argsort(rank)]
        return frame.assign(label=rank[hard].astype("int32"), p=list(p))

    rows = df.dropna(subset=features).select("ticker", "ts", *features)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("ticker").applyInPandas(fit, f"{fields}, label int, p array<double>")


def mixture_regimes(df: DataFrame, x: str, y: str, transformed: bool = False, restarts: int = 10, rounds: int = 500) -> DataFrame:
    """``fit_predict`` of a plane: two features, three clusters."""
    return fit_predict(df, [x, y], 3, transformed, restarts, rounds)


def walk_forward_regimes(df: DataFrame, x: str, y: str, days: int = REFIT_DAYS, bars: int = REFIT_BARS, least: int = 10) -> DataFrame:
    """(ticker, ts, label): each bar from the ``least``-th on by a mixture of the last ``bars`` rows, or what there is, refitted when ``days`` have passed."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts").reset_index(drop=True)
        raw, ts = frame[[x, y]].to_numpy(float), pd.to_datetime(frame["ts"])
        out, model, fitted = [], None, None
        for i in range(min(least, bars) - 1, len(frame)):
            if model is None or (ts[i] - fitted).days >= days:
                model, fitted = fit_mixture(raw[max(0, i + 1 - bars) : i + 1]), ts[i]
                rank = semantic_order(model["means"])
            logs = [log_density(raw[i : i + 1], model["means"][j], model["covs"][j])[0] + math.log(model["weights"][j]) for j in range(3)]
            out.append((frame["ticker"][i], frame["ts"][i], int(rank[int(np.argmax(logs))])))
        return pd.DataFrame(out, columns=["ticker", "ts", "label"]).astype({"label": "int32"})

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("ticker", "ts", x, y)
    return rows.groupBy("ticker").applyInPandas(walk, f"ticker string, ts {rows.schema['ts'].dataType.simpleString()}, label int")


def moments(df: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """(cluster, w, mx, my, sxx, sxy, syy): share, centre and covariance of each cluster of a plane, by given labels."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cluster).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("sxx"), F.covar_pop(x, y).alias("sxy"), F.var_pop(y).alias("syy"))
    return own.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy())).select(cluster, "w", "mx", "my", "sxx", "sxy", "syy")


def posterior(x: Column, y: Column, params: list[dict]) -> Column:
    """array<double> of the components' shares, from given weights, means and covariances (sxx, sxy, syy)."""
    logs = []
    for c in params:
        det = c["sxx"] * c["syy"] - c["sxy"] ** 2
        dx, dy = x - c["mx"], y - c["my"]
        q = (dx * dx * c["syy"] - 2 * dx * dy * c["sxy"] + dy * dy * c["sxx"]) / det
        logs.append(-0.5 * q + math.log(c["w"]) - 0.5 * math.log(det) - math.log(2 * math.pi))
    top = F.greatest(*logs)
    each = [F.exp(v - top) for v in logs]
    return F.array(*(e / sum(each[1:], each[0]) for e in each))


def semantic_posterior(p: Column, mapping: dict[int, int]) -> Column:
    """Shares by semantic label: those of clusters with one label add up."""
    out = []
    for label in range(max(mapping.values()) + 1):
        own = [F.get(p, F.lit(c)) for c, v in mapping.items() if v == label]
        out.append(sum(own[1:], own[0]) if own else F.lit(0.0))
    return F.array(*out)


def top_label(p: Column) -> Column:
    """The first label of the greatest share."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ellipse(mx, my, sxx, sxy, syy, n_std: float = 2.0) -> dict[str, Column]:
    """Covariance ellipse: full axes of ``n_std`` deviations, and the major axis' angle in degrees."""
    mid, half = (sxx + syy) / 2, F.sqrt(((sxx - syy) / 2) * ((sxx - syy) / 2) + sxy * sxy)
    angle = F.degrees(F.atan2(mid + half - sxx, sxy))
    angle = F.when(sxy == 0, F.when(sxx >= syy, 0.0).otherwise(90.0)).otherwise(angle)
    return {"cx": mx, "cy": my, "width": 2 * n_std * F.sqrt(mid + half), "height": 2 * n_std * F.sqrt(F.greatest(mid - half, F.lit(0.0))), "angle": angle}


def polyline(df: DataFrame, points: int = 100) -> DataFrame:
    """(…, i, x, y): the ellipse's outline from its centre, axes and angle."""
    own = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t, a = F.col("i") * (2 * math.pi / (points - 1)), F.radians("angle")
    u, v = F.col("width") / 2 * F.cos(t), F.col("height") / 2 * F.sin(t)
    return own.withColumns({"x": F.col("cx") + u * F.cos(a) - v * F.sin(a), "y": F.col("cy") + u * F.sin(a) + v * F.cos(a)})


# ---- hysteresis -------------------------------------------------------------------------------


def step(held: int | None, pending: int | None, count: int, p, hard: float, soft: float, persist: int) -> tuple[int, int | None, int]:
    """One bar of the trigger: (held, pending, count) after posteriors ``p``."""
    p = list(p)
    top = p.index(max(p))
    if held is None or top == held:
        return (top if held is None else held), None, 0
    margin = float(p[top]) - float(p[held])
    if margin >= hard:
        return top, None, 0
    if margin < soft:
        return held, None, 0
    count = count + 1 if pending == top else 1
    return (top, None, 0) if count >= persist else (held, top, count)


def check(hard: float, soft: float, persist: int) -> None:
    if hard < soft or persist < 1:
        raise ValueError("hysteresis needs hard >= soft and a persistence of one bar or more")


def held_labels(p: list, hard: float, soft: float, persist: int) -> list[int]:
    held, pending, count, out = None, None, 0, []
    for x in p:
        held, pending, count = step(held, pending, count, x, hard, soft, persist)
        out.append(held)
    return out


def hysteresis(df: DataFrame, hard: float = HARD, soft: float = SOFT, persist: int = PERSIST) -> DataFrame:
    """(ticker, ts, raw, held) from posteriors (ticker, ts, p): maps of blocks of bars, composed along each ticker."""
    check(hard, soft, persist)
    return trigger.scan(df, hard, soft, persist)


def flips(df: DataFrame, label: str) -> DataFrame:
    """(ticker, n_bars, flips, flips_per_year)."""
    own = df.withColumn("flip", (F.col(label) != F.lag(label).over(w())).cast("int"))
    return own.groupBy("ticker").agg(F.count("*").alias("n_bars"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips")).withColumn("flips_per_year", F.col("flips") * float(YEAR) / F.col("n_bars"))


def diagnostics(df: DataFrame) -> DataFrame:
    """Raw against held labels: flips a year, suppressed flips, agreement."""
    own = df.withColumns({"fr": (F.col("raw") != F.lag("raw").over(w())).cast("int"), "fh": (F.col("held") != F.lag("held").over(w())).cast("int")})
    out = own.groupBy("ticker").agg(F.count("*").alias("n_bars"), F.coalesce(F.sum("fr"), F.lit(0)).alias("raw_flips"), F.coalesce(F.sum("fh"), F.lit(0)).alias("held_flips"), F.avg((F.col("raw") == F.col("held")).cast("double")).alias("agreement"))
    return out.withColumns({"suppressed": F.greatest(F.lit(0), F.col("raw_flips") - F.col("held_flips")), "raw_per_year": F.col("raw_flips") * float(YEAR) / F.col("n_bars"), "held_per_year": F.col("held_flips") * float(YEAR) / F.col("n_bars")})


def calibration(df: DataFrame) -> DataFrame:
    """Every setting of the grid on each ticker's posteriors, with its fitness columns and rank."""
    grid = [(h, s, t) for h in HARD_GRID for s in SOFT_GRID for t in PERSIST_GRID if h >= s]
    settings = F.array(*(F.struct(F.lit(h).alias("hard"), F.lit(s).alias("soft"), F.lit(t).cast("int").alias("persist")) for h, s, t in grid))
    return ranked(trigger.flip_counts(df, grid).withColumn("set", F.get(settings, F.col("setting"))).select("*", "set.*"))


def ranked(found: DataFrame) -> DataFrame:
    """Fitness columns and rank of counted settings (ticker, hard, soft, persist, n, raw_flips, held_flips, same)."""
    yearly = lambda c: F.col(c) * float(YEAR) / F.col("n")
    out = found.select("ticker", "hard", "soft", "persist", yearly("raw_flips").alias("raw_per_year"), yearly("held_flips").alias("held_per_year"), (F.col("same") / F.col("n")).alias("agreement"))
    out = out.withColumns({"in_band": F.col("held_per_year").between(FLIPS_LOW, FLIPS_HIGH), "distance": F.abs(F.col("held_per_year") - (FLIPS_LOW + FLIPS_HIGH) / 2), "width": F.round(F.col("hard") - F.col("soft"), 6)})
    order = Window.partitionBy("ticker").orderBy(F.desc("in_band"), F.round("distance", 6), "width", "persist", "hard")
    return out.withColumn("place", F.row_number().over(order))

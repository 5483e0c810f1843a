"""Gaussian mixtures over tables that no task holds, and refits that run side by side.

``pooled_mixture`` fits one mixture to all rows of all tickers: each round of expectation maximisation is one
aggregation of expressions, whose row of sufficient statistics (weights, sums, products around the last means)
goes to the driver.  Starts are those of k-means||: points drawn in proportion to their distance over a few
passes, weighted by the points they stand for, and clustered on the driver (some dozens, whatever the table).

``walk_forward`` turns the chain of refits into rows: a refit's window lies inside a block of bars and its halo,
so fits are dealt to tasks; each bar is joined to the model in force by the number of refits up to it.

Rows with a null feature are left out.  Fewer different rows than clusters give no model (None, or no rows).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import numbered, running_sum
from ..functions.shared import written
from .regimes import REFIT_BARS, REFIT_DAYS, fit_mixture, semantic_order

#: Passes of k-means||, points drawn in each (times the clusters), and rounds of its means over the table.
PASSES, DRAWN, MEANS = 5, 2, 5
RIDGE = 1e-6


def _logs(x: list[Column], model: dict) -> list[Column]:
    """log(weight * density) of each cluster."""
    out = []
    for w, m, c in zip(model["weights"], model["means"], model["covs"]):
        inverse, d = np.linalg.inv(c), [a - F.lit(float(b)) for a, b in zip(x, m)]
        q = sum((float(inverse[i, j]) * (1 if i == j else 2) * d[i] * d[j] for i in range(len(x)) for j in range(i, len(x))), F.lit(0.0))
        out.append(F.lit(math.log(w) - 0.5 * math.log(np.linalg.det(c)) - len(x) / 2 * math.log(2 * math.pi)) - 0.5 * q)
    return out


def _sums(table: DataFrame, features: list[str], shares: list[Column], centres: np.ndarray, *more: Column):
    """The aggregation of a round: for each cluster the weight, and first and second moments around its centre."""
    d, cols = len(features), []
    for j, (share, m) in enumerate(zip(shares, centres)):
        gap = [F.col(f) - F.lit(float(v)) for f, v in zip(features, m)]
        cols += [F.sum(share), *(F.sum(share * g) for g in gap), *(F.sum(share * gap[a] * gap[b]) for a in range(d) for b in range(a, d))]
    row = table.agg(*(c.alias(f"s{i}") for i, c in enumerate([*cols, *more]))).first()
    each = 1 + d + d * (d + 1) // 2
    return np.array([x if x is not None else 0.0 for x in row[: len(shares) * each]], float).reshape(len(shares), each), row[len(shares) * each :]


def _maximised(sums: np.ndarray, centres: np.ndarray, n: int) -> dict:
    k, d = centres.shape
    weight = sums[:, 0] + 1e-10
    step = sums[:, 1 : 1 + d] / weight[:, None]
    covs = np.zeros((k, d, d))
    for j in range(k):
        at = 1 + d
        for a in range(d):
            for b in range(a, d):
                covs[j, a, b] = covs[j, b, a] = sums[j, at] / weight[j] - step[j, a] * step[j, b]
                at += 1
        covs[j] += RIDGE * np.eye(d)
    return {"weights": weight / n, "means": centres + step, "covs": covs}


def _near(table: DataFrame, features: list[str], centres: np.ndarray) -> DataFrame:
    """``table`` with ``gap``, the squared distance to the nearest centre, and ``near``, the first centre as near."""
    gaps = [sum(((F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(features, m)), F.lit(0.0)) for m in centres]
    own = table.select(*features, F.array(*gaps).alias("gaps")).withColumn("gap", F.array_min("gaps"))
    return own.withColumn("near", F.array_position("gaps", F.col("gap")) - 1).drop("gaps")


def _hard(centres: np.ndarray) -> list[Column]:
    return [(F.col("near") == j).cast("double") for j in range(len(centres))]


def spread_start(table: DataFrame, features: list[str], k: int, seed: int) -> np.ndarray | None:
    """``k`` centres by k-means||, then ``MEANS`` rounds of means over the table; None if there are fewer different rows."""
    draw = lambda t: F.pmod(F.xxhash64(*features, F.lit(seed), F.lit(t)), F.lit(1 << 40)) / float(1 << 40)
    first = table.orderBy(draw(-1)).limit(1).collect()
    if not first:
        return None
    found = [tuple(first[0][f] for f in features)]
    for t in range(PASSES):
        near = _near(table, features, np.array(found))
        total = near.agg(F.sum("gap")).first()[0]
        if not total:
            break
        rows = near.where(draw(t) * F.lit(float(total)) < F.col("gap") * (DRAWN * k)).select(*features).distinct().collect()  # DRAWN * k in expectation
        found += [r for r in map(tuple, rows) if r not in set(found)]
    points = np.array(found)
    if len(points) < k:
        return None
    weight = np.zeros(len(points))
    for at, n in _near(table, features, points).groupBy("near").count().collect():  # a row for each point
        weight[at] = n
    rng = np.random.default_rng(seed)
    centres = points[[rng.choice(len(points), p=weight / weight.sum())]]
    while len(centres) < k:
        gap = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * np.maximum(weight, 1e-9)
        centres = np.vstack([centres, points[rng.choice(len(points), p=gap / gap.sum())]])
    for _ in range(50):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([np.average(points[own == j], axis=0, weights=weight[own == j]) if weight[own == j].sum() > 0 else centres[j] for j in range(k)])
    for _ in range(MEANS):
        sums, _ = _sums(_near(table, features, centres), features, _hard(centres), centres)
        step = sums[:, 1 : 1 + len(features)] / np.maximum(sums[:, :1], 1)
        centres = centres + step
        if np.abs(step).max() < 1e-9:
            break
    return centres


def expectation_maximisation(table: DataFrame, features: list[str], centres: np.ndarray, rounds: int = 500, tolerance: float = 1e-3) -> dict:
    """From hard shares by the nearest centre on, until the mean log-likelihood moves by less than ``tolerance``."""
    sums, (n,) = _sums(_near(table, features, centres), features, _hard(centres), centres, F.count("*"))
    model, last = _maximised(sums, centres, n), -math.inf
    for done in range(1, rounds + 1):
        logs = _logs([F.col(f) for f in features], model)
        names = [f"log_{j}" for j in range(len(logs))]
        scored = table.select(*features, *(c.alias(x) for c, x in zip(logs, names)))
        top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        scored = scored.withColumn("norm", top + F.log(sum((F.exp(F.col(x) - top) for x in names), F.lit(0.0))))
        sums, (fit,) = _sums(scored, features, [F.exp(F.col(x) - F.col("norm")) for x in names], model["means"], F.avg("norm"))
        if abs(fit - last) < tolerance or done == rounds:
            return model | {"fit": fit, "rounds": done}
        model, last = _maximised(sums, model["means"], n), fit


def pooled_mixture(df: DataFrame, features: list[str], k: int = 3, restarts: int = 3, rounds: int = 500, tolerance: float = 1e-3, seed: int = 42) -> dict | None:
    """{weights, means, covs, fit, rounds}: one mixture of all rows, the best of several starts."""
    table = written(df.dropna(subset=features).select(*(F.col(f).cast("double").alias(f) for f in features)), "pooled")
    best = None
    for start in range(restarts):
        centres = spread_start(table, features, k, seed + start)
        if centres is None:
            return None
        model = expectation_maximisation(table, features, centres, rounds, tolerance)
        if best is None or model["fit"] > best["fit"]:
            best = model
    return best


def assigned(df: DataFrame, features: list[str], model: dict) -> DataFrame:
    """``df`` with ``p`` (shares by semantic label) and ``label``; null where a feature is."""
    order = np.argsort(semantic_order(model["means"]))
    logs = [_logs([F.col(f) for f in features], model)[j] for j in order]
    top = F.greatest(*logs)
    each = [F.exp(v - top) for v in logs]
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    p = F.array(*(e / sum(each[1:], each[0]) for e in each))
    out = df.withColumn("p", F.when(known, p))
    return out.withColumn("label", (F.array_position("p", F.array_max("p")) - 1).cast("int"))


# ---- refits -----------------------------------------------------------------------------------


def refit_rows(rows: DataFrame, days: int, first: int) -> DataFrame:
    """(ticker, at): the bars at which a model is fitted anew, from the bar numbered ``first`` on, each the first bar
    ``days`` days or more after the one before.  Only the bars' times are brought together by ticker."""

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        ts = pd.to_datetime(frame["ts"]).to_numpy()
        at, out = 0, []
        while at < len(ts):
            out.append(int(frame["at"].iloc[at]))
            at = max(at + 1, int(np.searchsorted(ts, ts[at] + np.timedelta64(days, "D"))))
        return pd.DataFrame({"ticker": frame["ticker"].iloc[0], "at": out})

    return rows.where(F.col("at") >= first).select("ticker", "ts", "at").groupBy("ticker").applyInPandas(chain, "ticker string, at bigint")


def walk_forward(df: DataFrame, x: str, y: str, days: int = REFIT_DAYS, bars: int = REFIT_BARS, least: int = 10, size: int = 256) -> DataFrame:
    """(ticker, ts, label): each bar from the ``least``-th on by a mixture of the last ``bars`` rows, or what there is,
    refitted when ``days`` have passed."""
    first = min(least, bars) - 1
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("ticker", "ts", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = written(numbered(known), "walk")
    flagged = rows.join(refit_rows(rows, days, first).withColumn("refit", F.lit(1)), ["ticker", "at"], "left")
    flagged = written(running_sum(flagged, "refit", "fit"), "refits")

    def fits(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        raw, at, out = frame[["x", "y"]].to_numpy(float), frame["at"].to_numpy(), []
        for i in np.flatnonzero((frame["refit"] == 1).to_numpy() & (at // size == frame["block"].to_numpy())):
            m = fit_mixture(raw[max(0, i + 1 - bars) : i + 1])
            rank = semantic_order(m["means"])
            out.append((frame["ticker"].iloc[0], int(frame["fit"].iloc[i]), [(int(rank[j]), float(m["weights"][j]), *map(float, m["means"][j]), float(m["covs"][j][0, 0]), float(m["covs"][j][0, 1]), float(m["covs"][j][1, 1])) for j in range(3)]))
        return pd.DataFrame(out, columns=["ticker", "fit", "model"])

    block = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + bars - 1) / size)))
    kind = "ticker string, fit bigint, model array<struct<label:int,w:double,mx:double,my:double,sxx:double,sxy:double,syy:double>>"
    models = flagged.withColumn("block", block).groupBy("ticker", "block").applyInPandas(fits, kind)

    def score(c: Column) -> Column:
        det = c["sxx"] * c["syy"] - c["sxy"] * c["sxy"]
        dx, dy = F.col("x") - c["mx"], F.col("y") - c["my"]
        return F.log(c["w"]) - 0.5 * F.log(det) - 0.5 * (dx * dx * c["syy"] - 2 * dx * dy * c["sxy"] + dy * dy * c["sxx"]) / det

    own = flagged.where(F.col("at") >= first).join(models, ["ticker", "fit"]).withColumn("scores", F.transform("model", score))
    place = F.array_position("scores", F.array_max("scores")).cast("int")
    return own.select("ticker", "ts", F.element_at("model", place)["label"].alias("label"))

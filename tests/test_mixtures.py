"""Distributed mixtures and refits against the same in one task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import entropy as E, mixtures as M, regimes as G, returns as R
from tidemark.sources import bars as B


def blobs(spark, d=2, n=1500, seed=42):
    rng = np.random.default_rng(seed)
    centres = np.array([[0.65, 0.8, 1.0], [0.85, 1.2, 2.0], [0.95, 2.5, -1.0]])[:, :d]
    x = np.concatenate([rng.standard_normal((m, d)) * 0.05 + c for m, c in zip((n // 2, n // 3, n // 6), centres)])
    names = list("abc")[:d]
    return spark.createDataFrame([(f"t{i % 7}", i, *map(float, v)) for i, v in enumerate(x)], "ticker string, ts int, " + ", ".join(f"{c} double" for c in names)).repartition(5), x, names


@pytest.mark.parametrize("d", [2, 3])
def test_pooled_fit_equals_a_single_task_fit(spark, d):
    df, x, names = blobs(spark, d)
    odd = df.unionByName(spark.createDataFrame([("n", 0, *[None] * d)], df.schema))
    model = M.pooled_mixture(odd, names, 3, restarts=1, tolerance=1e-10)
    single = G.fit_mixture(x, 3, 5, 500, tolerance=1e-10)
    assert abs(model["fit"] - single["fit"]) < 1e-6
    order, other = np.argsort(model["means"].sum(axis=1)), np.argsort(single["means"].sum(axis=1))
    assert np.allclose(model["means"][order], single["means"][other], atol=1e-5) and np.allclose(model["weights"][order], single["weights"][other], atol=1e-5)
    assert np.allclose(model["covs"][order], single["covs"][other], atol=1e-6)
    out = M.assigned(odd, names, model).collect()
    assert all((r["label"] is None) == (r["ticker"] == "n") for r in out)
    rank = G.semantic_order(single["means"])
    labels = {r["ts"]: r["label"] for r in out if r["label"] is not None}
    assert [labels[i] for i in range(len(x))] == rank[single["share"].argmax(axis=1)].tolist()


def test_rounds_over_all_brands_equal_those_of_one_task(spark):
    own = R.rolling_volatility(E.permutation_entropy(R.log_returns(B.by_brand(spark, DATA)))).where("wpe IS NOT NULL AND rv22 IS NOT NULL").select("ticker", "ts", "wpe", (F.col("rv22") / 100).alias("v"))
    table = own.select("wpe", "v").cache()
    x = np.array(table.collect(), float)
    centres = M.spread_start(table, ["wpe", "v"], 3, 1)
    share = np.eye(3)[((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    for rounds in (1, 12):
        model = M.expectation_maximisation(table, ["wpe", "v"], centres, rounds, 0.0)
        own_share = share
        for _ in range(rounds):
            weight = own_share.sum(axis=0) + 1e-10
            means = own_share.T @ x / weight[:, None]
            covs = [((own_share[:, j, None] * (x - means[j])).T @ (x - means[j])) / weight[j] + 1e-6 * np.eye(2) for j in range(3)]
            logs = np.stack([G.log_density(x, means[j], covs[j]) + math.log(weight[j] / len(x)) for j in range(3)], axis=1)
            norm = np.logaddexp.reduce(logs, axis=1)
            own_share = np.exp(logs - norm[:, None])
        assert abs(model["fit"] - norm.mean()) < 1e-6 and np.allclose(model["means"], means, rtol=1e-6) and np.allclose(model["covs"], covs, rtol=1e-5, atol=1e-9)
    table.unpersist()


def test_too_few_rows(spark):
    same = spark.createDataFrame([("a", i, 1.0, 2.0) for i in range(20)], "ticker string, ts int, a double, b double")
    assert M.pooled_mixture(same, ["a", "b"]) is None and M.pooled_mixture(same.where("ts < 0"), ["a", "b"]) is None


def test_refits_side_by_side_equal_the_walk(spark):
    own = E.permutation_entropy(R.log_returns(B.daily(spark, DATA))).where("ts < '1996-01-01'")
    brands = R.rolling_volatility(E.permutation_entropy(R.log_returns(B.by_brand(spark, DATA)))).where("ticker IN ('Brand#11', 'Brand#25')").withColumn("complexity", F.col("rv22") / 100)
    df = own.select("ticker", "ts", "wpe", "complexity").unionByName(brands.select("ticker", "ts", "wpe", "complexity"))
    want = {(r["ticker"], r["ts"]): r["label"] for r in G.walk_forward_regimes(df, "wpe", "complexity", bars=120).collect()}
    got = {(r["ticker"], r["ts"]): r["label"] for r in M.walk_forward(df, "wpe", "complexity", bars=120, size=64).collect()}
    assert got == want and len({t for t, _ in want}) == 3 and set(want.values()) == {0, 1, 2}
    assert M.walk_forward(df.where("wpe > 9"), "wpe", "complexity").count() == 0

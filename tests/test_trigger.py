"""The trigger's scan against its step-by-step machine."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import regimes as G, trigger


def posteriors(spark, kind="int", labels=3):
    rng = random.Random(8)
    rows = []
    for ticker, n in (("long", 700), ("short", 5), ("one", 1), ("calm", 300)):
        p = [1 / labels] * labels
        for k in range(n):
            target = [rng.random() ** (1 if ticker == "calm" else 4) for _ in range(labels)]
            p = [0.7 * a + 0.3 * b / sum(target) for a, b in zip(p, target)] if rng.random() < 0.9 else [b / sum(target) for b in target]
            rows.append((ticker, k * 3, [x / sum(p) for x in p]))
    return spark.createDataFrame(rows, "ticker string, ts int, p array<double>").repartition(3), rows


def plain(rows, hard, soft, persist):
    out = {}
    for ticker in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == ticker]
        for r, held in zip(own, G.held_labels([r[2] for r in own], hard, soft, persist)):
            out[ticker, r[1]] = (r[2].index(max(r[2])), held)
    return out


@pytest.mark.parametrize("size, fan, setting", [(1, 2, (0.2, 0.05, 3)), (7, 3, (0.3, 0.05, 2)), (64, 2, (0.15, 0.15, 8)), (256, 512, (0.2, 0.1, 1)), (32, 4, (0.25, 0.02, 13))])
def test_scan_equals_steps(spark, size, fan, setting):
    df, rows = posteriors(spark)
    got = {(r["ticker"], r["ts"]): (r["raw"], r["held"]) for r in trigger.scan(df, *setting, size=size, fan=fan).collect()}
    want = plain(rows, *setting)
    assert got == want and len({h for _, h in want.values()}) == 3 and any(a != b for a, b in want.values())


def test_two_labels_and_no_rows(spark):
    df, rows = posteriors(spark, labels=2)
    assert {(r["ticker"], r["ts"]): (r["raw"], r["held"]) for r in G.hysteresis(df, 0.2, 0.1, 3).collect()} == plain(rows, 0.2, 0.1, 3)
    assert G.hysteresis(df.where("ts < 0"), 0.2, 0.1, 3).count() == 0
    with pytest.raises(ValueError):
        G.hysteresis(df, 0.1, 0.2, 3)


@pytest.mark.parametrize("size, fan", [(16, 3), (256, 512)])
def test_every_setting_at_once(spark, size, fan):
    df, rows = posteriors(spark)
    settings = [(0.3, 0.1, 3), (0.2, 0.05, 8), (0.1, 0.1, 1)]
    got = {(r["ticker"], r["setting"]): (r["n"], r["raw_flips"], r["held_flips"], r["same"]) for r in trigger.flip_counts(df, settings, size, fan).collect()}
    count = lambda v: sum(a != b for a, b in zip(v, v[1:]))
    for k, setting in enumerate(settings):
        want = plain(rows, *setting)
        for ticker in {r[0] for r in rows}:
            both = [want[t] for t in sorted(want) if t[0] == ticker]
            raw, held = [a for a, _ in both], [b for _, b in both]
            assert got[ticker, k] == (len(both), count(raw), count(held), sum(a == b for a, b in both))


def test_a_long_series_is_many_tasks(spark):
    df, _ = posteriors(spark)
    blocks, labels, longest = trigger.cut(df.where("ticker = 'long'"), 64)
    assert (labels, longest, blocks.count()) == (3, 11, 11) and blocks.agg(F.max(F.size("p"))).first()[0] == 64


#: Posteriors by case and the labels that must come out at (0.40, 0.20, 3) (fixed values).
GOLDEN = {
    "noise": ([[0.80, 0.10, 0.10], [0.40, 0.45, 0.15], [0.75, 0.15, 0.10]], [0, 0, 0]),
    "hard": ([[0.80, 0.10, 0.10], [0.10, 0.85, 0.05]], [0, 1]),
    "drift": ([[0.80, 0.10, 0.10], [0.30, 0.60, 0.10], [0.30, 0.60, 0.10], [0.30, 0.60, 0.10], [0.10, 0.65, 0.25]], [0, 0, 0, 1, 1]),
    "switch": ([[0.80, 0.10, 0.10], [0.30, 0.60, 0.10], [0.30, 0.10, 0.60], [0.30, 0.60, 0.10]], [0, 0, 0, 0]),
}


@pytest.mark.parametrize("size", [2, 256])
def test_golden_cases(spark, size):
    rows = [(c, i, p) for c, (ps, _) in GOLDEN.items() for i, p in enumerate(ps)]
    got = {(r["ticker"], r["ts"]): r["held"] for r in trigger.scan(spark.createDataFrame(rows, "ticker string, ts int, p array<double>"), 0.40, 0.20, 3, size=size, fan=2).collect()}
    assert got == {(c, i): h for c, (_, hs) in GOLDEN.items() for i, h in enumerate(hs)}

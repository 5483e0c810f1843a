"""State between micro-batches: resets, a table of known states, expiry by timer."""

import random

from tidemark.operators import regimes as G
from tidemark.streaming import ticks as K

SCHEMA = "ticker string, ts int, p array<double>"
SETTING = (0.3, 0.05, 3)


def posteriors(ticker, first, n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        p = [rng.random() ** 2 for _ in range(3)]
        out.append((ticker, first + k, [x / sum(p) for x in p]))
    return out


def run(spark, tmp_path, files, **more):
    for rows in files:  # one micro-batch each
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    with K.rocks(spark):
        stream = K.trigger_stream(K.tick_stream(spark, str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema), *SETTING, **more)
        K.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    return {(r["ticker"], r["ts"]): r["held"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def walked(rows, state=(None, None, 0)):
    out = {}
    for ticker, ts, p in rows:
        state = G.step(*state, p, *SETTING)
        out[ticker, ts] = state[0]
    return out


def test_reset_and_known_states(spark, tmp_path):
    a, b = posteriors("a", 0, 60, 1), posteriors("b", 0, 40, 13)
    known = spark.createDataFrame([("b", 2, 1, 2)], "ticker string, held int, pending int, count int")
    files = [a[:25] + b[:10], a[25:40] + [("a", 30, None)] + b[10:], a[40:]]
    got = run(spark, tmp_path, files, known=known)
    assert got == walked(a[:30]) | walked(a[30:]) | walked(b, (2, 1, 2))
    assert got != walked(a) | walked(b) and walked(b) != walked(b, (2, 1, 2))


def test_idle_tickers_are_given_up(spark, tmp_path):
    a, b = posteriors("a", 0, 60, 3), posteriors("b", 0, 40, 13)
    got = run(spark, tmp_path, [a[:20] + b[:20], a[20:40], a[40:] + b[20:]], idle=1, keep=3_600_000)
    assert got != walked(a) | walked(b)
    # b had no rows in the second batch, whose timer cleared it; the timers of a are set anew with its rows
    assert got == walked(a) | walked(b[:20]) | walked(b[20:])

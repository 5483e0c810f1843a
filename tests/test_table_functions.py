"""The trigger's table function against the block-wise counts, with batches of few rows, ties, nulls and odd partitions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import regimes as G, table_functions as TF, trigger

SCHEMA = "ticker string, ts int, p array<double>"
NAMES = ["ticker", "hard", "soft", "persist", "n", "raw_flips", "held_flips", "same"]


def series(seed, tickers, bars):
    rng = random.Random(seed)
    return [(t, i, [rng.choice([0.0, 0.2, 0.4, 0.4, 0.7]) for _ in range(3)]) for t in tickers for i in range(bars)]


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_counts_equal_the_block_wise_ones(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(series(3, ["A", "B"], 300) + [("C", 0, [0.1, 0.9, 0.0])], SCHEMA).repartition(5)
        hard, soft, persist = [0.2, 0.4], [0.1, 0.3], [1, 3]
        grid = [(h, s, t) for h in hard for s in soft for t in persist if h >= s]
        got = {tuple(r[:4]): tuple(r[4:]) for r in TF.counts(df, hard, soft, persist).select(NAMES).collect()}
        want = {(r["ticker"], *grid[r["setting"]]): (r["n"], r["raw_flips"], r["held_flips"], r["same"]) for r in trigger.flip_counts(df, grid, 32, 4).collect()}
        assert got == want and len(got) == 3 * len(grid)
        for h, s, t in grid:  # and step by step
            p = [r["p"] for r in df.where("ticker = 'A'").orderBy("ts").collect()]
            held = G.held_labels(p, h, s, t)
            assert got["A", h, s, t][2:] == (sum(a != b for a, b in zip(held, held[1:])), sum(a == x.index(max(x)) for a, x in zip(held, p)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert TF.counts(none, [0.4], [0.2], [3]).isEmpty()
    df = spark.createDataFrame([(None, 0, [0.5, 0.5]), (None, 1, None), (None, 2, [0.0, 1.0])], SCHEMA)
    assert [tuple(r) for r in TF.counts(df, [0.4], [0.2], [3]).select(NAMES).collect()] == [(None, 0.4, 0.2, 3, 3, 1, 1, 3)]
    assert TF.counts(df, [0.1], [0.2], [3]).isEmpty()  # no setting has hard >= soft
    longer = spark.createDataFrame([("A", i, [0.1] * (2 + (i == 0))) for i in range(3)], SCHEMA)
    assert TF.counts(longer, [0.4], [0.2], [3]).first()["n"] == 3


def test_sql_with_a_lateral_table(spark):
    TF.register(spark)
    df = spark.createDataFrame(series(5, ["A"], 50), SCHEMA).withColumn("settings", F.array(F.struct(F.lit(0.4).alias("hard"), F.lit(0.2).alias("soft"), F.lit(3).alias("persist"))))
    rows = spark.sql(f"SELECT * FROM {TF.NAME}(TABLE({{df}}) PARTITION BY ticker ORDER BY ts)", df=df).collect()
    assert len(rows) == 1 and rows[0]["n"] == 50

"""Tables that are kept under a key: reuse, change of source or parameters, expiry, cleaning."""

import os
import time

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import shared as K
from tidemark.plans import market


def test_kept_tables(spark, tmp_path):
    source, made = str(tmp_path / "source.parquet"), []
    spark.range(5).write.parquet(source)

    def ask(more=0, seconds=60.0):
        def make():
            made.append(more)
            return spark.read.parquet(source).withColumn("x", F.col("id") + more)

        return sorted(r["x"] for r in K.kept(spark, "test", {"source": K.version(spark, source), "more": more}, make, seconds).collect())

    assert ask() == ask() == [0, 1, 2, 3, 4] and made == [0]
    assert ask(7) == [7, 8, 9, 10, 11] and ask(7) and made == [0, 7]  # another parameter, another table
    spark.range(5, 7).write.mode("append").parquet(source)
    assert ask() == [0, 1, 2, 3, 4, 5, 6] and made == [0, 7, 0]  # another file, another table
    time.sleep(1.1)
    assert len(ask(seconds=1.0)) == 7 and made == [0, 7, 0, 0]  # expired
    before = K.clean(spark, 3600)
    assert before == 0 and K.clean(spark, 0) == 4 and K.clean(spark, 0) == 0
    assert len(ask()) == 7 and len(made) == 5


def test_unfinished_tables_do_not_count(spark):
    home = f"{K.root_folder(spark)}/{K.KEPT}/half-x"
    K.written(spark.range(1), "other")
    os.makedirs(f"{home.removeprefix('file:')}/writing")
    assert K._tables(spark, home) == []


def test_features_are_made_once(spark, monkeypatch):
    real, calls = market.features, []
    monkeypatch.setattr(market, "features", lambda *a: calls.append(1) or real(*a))
    K.clean(spark, 0)
    one, two = (market.kept_features(spark, DATA) for _ in range(2))
    assert len(calls) == 1 and one.inputFiles() == two.inputFiles() and one.count() == real(spark, DATA).count()

"""The bar source: filters that reach it, pages, fallback, odd files, streams."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.sources import bars as B, connector as C


@pytest.fixture(scope="module")
def bars(spark):
    return B.by_brand(spark, DATA).persist()


@pytest.fixture(scope="module")
def store(bars, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("store") / "bars")
    C.export_store(bars, at)
    return at


def test_options_prune_folders_and_rows(spark, bars, store):
    C.register(spark)
    source = lambda **o: spark.read.format(C.FORMAT).options(**o).load(store)
    rows = source()
    assert rows.exceptAll(bars).isEmpty() and rows.count() == bars.count()
    two = '["Brand#13", "Brand#22"]'
    for case, options in (("ticker = 'Brand#13'", {"tickers": '["Brand#13"]'}), ("ticker IN ('Brand#13', 'Brand#22') AND ts >= '1994-03-01' AND ts <= '1995-02-01'", {"tickers": two, "first": "1994-03-01", "last": "1995-02-01"}),
                          ("ticker = 'none'", {"tickers": '["none"]'}), ("false", {"tickers": "[]"}), ("ts = '1995-02-01'", {"first": "1995-02-01", "last": "1995-02-01"}), ("false", {"first": "1996-01-01", "last": "1995-01-01"})):
        got, want = source(**options), bars.where(case)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty(), case
    for case in ("ticker = 'Brand#13'", "ts < '1993-01-01' OR ticker = 'Brand#13'"):  # one frame, used again and again
        assert rows.where(case).count() == bars.where(case).count() > 0
    assert rows.where("ticker = 'Brand#13'").union(rows.where("ticker = 'Brand#22'")).count() == bars.where("ticker IN ('Brand#13', 'Brand#22')").count()
    reader = C.BarReader({"path": store, "page_bytes": "1", "tickers": '["Brand#13"]', "first": "1995-01-01", "last": "1995-02-01"})
    found = [p.path for page in reader.partitions() for p in page.pieces]
    assert found and all("ticker=Brand%2313/year=1995" in x for x in found)


def test_pages_cut_by_size(spark, tmp_path):
    n = 1000
    table = pa.table({"Ticker": ["A"] * n, " DATE ": pa.array([datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(n)]), "CLOSE": [float(i) for i in range(n)]})
    pq.write_table(table, tmp_path / "one.parquet", row_group_size=10)
    for k in range(5):
        pq.write_table(table.slice(k, 1), tmp_path / f"small{k}.parquet")
    size = (tmp_path / "one.parquet").stat().st_size // 7
    found = C.pages(str(tmp_path), C.files(str(tmp_path), C.Wanted()), size)
    assert sum(p.path.endswith("one.parquet") for page in found for p in page.pieces) in (7, 8)
    assert len(found) < 5 + 8  # small files share pages
    C.register(spark)
    rows = spark.read.format(C.FORMAT).option("page_bytes", size).load(str(tmp_path))
    assert rows.count() == n + 5 and rows.agg(F.sum("close")).first()[0] == n * (n - 1) / 2 + 10
    few = spark.read.format(C.FORMAT).options(page_bytes=size, first="2001-01-01", last="2001-01-10").load(str(tmp_path))
    assert few.count() == 10 and rows.where("volume IS NOT NULL").isEmpty()


def test_odd_files_and_fallback(spark, tmp_path):
    (tmp_path / "csv" / "ticker=__HIVE_DEFAULT_PARTITION__").mkdir(parents=True)
    (tmp_path / "csv" / "a.csv").write_text("Ngày, close ,Volume,Ticker\n2020-01-01,1.5,10,A\n2020-01-02,,x,A\nbad,3,,B\n,4,5,\n")
    (tmp_path / "csv" / "ticker=__HIVE_DEFAULT_PARTITION__" / "b.csv").write_text("date,close\n2020-01-03,7\n")
    (tmp_path / "csv" / "empty.csv").write_text("")
    (tmp_path / "csv" / "_SUCCESS").write_text("x")
    (tmp_path / "csv" / "note.txt").write_text("x")
    (tmp_path / "empty").mkdir()
    C.register(spark)
    at = lambda *p, **o: spark.read.format(C.FORMAT).options(**o).load(",".join(str(tmp_path / x) for x in p))
    rows = sorted((tuple(r) for r in at("csv").select("ticker", "ts", "close", "volume").collect()), key=repr)
    day = datetime.date
    assert rows == sorted([("A", day(2020, 1, 1), 1.5, 10.0), ("A", day(2020, 1, 2), None, None), ("B", None, 3.0, None), (rows_null(rows), None, 4.0, 5.0), (None, day(2020, 1, 3), 7.0, None)], key=repr)
    assert at("csv", tickers='["A"]', first="2020-01-02").count() == 1
    assert at("gone", "empty", "csv").count() == 5  # the first with bars is read
    assert at("csv", "gone", tickers='["none"]').isEmpty()  # a wish without rows is no reason to fall back
    assert at("empty").isEmpty() and at("gone", "empty").isEmpty()
    with pytest.raises(Exception, match="no bars at"):
        at("gone").count()
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format(C.FORMAT).load().count()
    filled = C.connect(spark, str(tmp_path / "csv"), tickers=["A"]).orderBy("ts").collect()
    assert [r["close"] for r in filled] == [1.5, 1.5] and [r["volume"] for r in filled] == [10.0, 10.0]


def rows_null(rows):
    """An empty ticker is empty text or null, as the CSV reader has it."""
    return next(r[0] for r in rows if r[2] == 4.0)


def test_stream_takes_each_file_once(spark, tmp_path):
    C.register(spark)

    def run():
        stream = spark.readStream.format(C.FORMAT).option("settle", "0").load(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["close"] for r in spark.read.schema(B.SCHEMA).parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text("date,close\n2020-01-01,1\n")
    assert run() == [1.0] == run()
    (tmp_path / "in" / "a.csv").write_text("date,close\n2020-01-02,2\n")  # its name sorts before
    assert run() == [1.0, 2.0] == run()
    young = C.BarStream({"path": str(tmp_path / "in"), "settle": "3600"})
    assert young.latestOffset() == young.initialOffset()

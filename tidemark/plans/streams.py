"""Streaming queries: each reads what is there, writes to the shared folder, and returns the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.shared import folder
from ..sources import bars as B, connector as C
from ..streaming import ticks as K
from . import market as M


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the events as a stream: each micro-batch writes the bars it changed, the open ones too, and the
    latest of each bar counts; what the watermark has closed leaves the state."""
    at, path = folder(spark), f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = K.bars(K.tick_stream(spark, path if _is_folder(spark, path) else f"{d}/event[s].parquet", schema))
    query = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/bars/batch={n}")).option("checkpointLocation", f"{at}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").parquet(f"{at}/bars")
    values = [c for c in stream.columns if c not in ("ticker", "ts")]
    last = rows.groupBy("ticker", "ts").agg(F.max_by(F.struct(*values), "batch").alias("bar"))
    return last.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "bar.*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """Held labels of the posteriors as a stream of four files, a micro-batch each."""
    at = folder(spark)
    own = M.posteriors(spark, d)
    own.withColumn("part", F.ntile(4).over(M.Window.partitionBy("ticker").orderBy("ts"))).write.partitionBy("part").parquet(f"{at}/in")
    # files are taken in the order of their times: they are written one after the other, a ticker's rows in one file
    for k in range(1, 5):
        spark.read.parquet(f"{at}/in/part={k}").repartition("ticker").sortWithinPartitions("ticker", "ts").write.mode("append").parquet(f"{at}/feed")
    stream = K.stateful_hysteresis(K.tick_stream(spark, f"{at}/feed", own.schema), 0.40, 0.20, 3)
    K.run_to_table(stream, f"{at}/out", f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select("ts", "held")


def stream_hysteresis_reset(spark: SparkSession, d: str) -> DataFrame:
    """The same with a control row that starts a new series at a pivot, and state that expires."""
    at = folder(spark)
    own = M.posteriors(spark, d)
    own.withColumn("part", F.ntile(3).over(M.Window.partitionBy("ticker").orderBy("ts"))).write.partitionBy("part").parquet(f"{at}/in")
    reset = own.select("ticker").distinct().select("ticker", F.lit(M.PIVOT).cast("date").alias("ts"), F.lit(None).cast("array<double>").alias("p"))
    bounds = spark.read.parquet(f"{at}/in").groupBy("part").agg(F.max("ts").alias("last")).orderBy("part").collect()  # three rows
    home = next((r["part"] for r in bounds if str(r["last"]) >= M.PIVOT), 3)
    for k in range(1, 4):  # files are taken in the order of their times
        rows = spark.read.parquet(f"{at}/in/part={k}").select(own.columns)
        (rows.unionByName(reset) if k == home else rows).repartition(1, "ticker").write.mode("append").parquet(f"{at}/feed")
    with K.rocks(spark):
        stream = K.trigger_stream(K.tick_stream(spark, f"{at}/feed", own.schema), 0.40, 0.20, 3, keep=86_400_000, idle=86_400_000)
        K.run_to_table(stream, f"{at}/out", f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select("ts", "held")


def stream_connector(spark: SparkSession, d: str) -> DataFrame:
    """A store of bars as a stream: what it holds before a pivot, then, from the same checkpoint, what is added after it."""
    at, own = folder(spark), B.by_brand(spark, d)
    C.register(spark)
    for part in (F.col("ts") < M.PIVOT, F.col("ts") >= M.PIVOT):
        C.export_store(own.where(part), f"{at}/store", "append")
        K.run_to_table(spark.readStream.format(C.FORMAT).option("settle", "0").load(f"{at}/store"), f"{at}/out", f"{at}/state")
    return spark.read.schema(B.SCHEMA).parquet(f"{at}/out")


QUERIES = {"stream_connector": stream_connector, "stream_bars": stream_bars, "stream_hysteresis": stream_hysteresis, "stream_hysteresis_reset": stream_hysteresis_reset}

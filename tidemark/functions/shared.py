"""Tables in the folder that driver and executors share: written once, or kept under a key and found again."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Seconds that a kept table is used for.
KEEP = 3600
KEPT = "kept"


def root_folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in local mode, where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark.sparkContext.applicationId
        if own not in _made:
            _made[own] = tempfile.mkdtemp(prefix="spark-")
        root = _made[own]
    return root.rstrip("/")


#: Folders made for local sessions, by application.
_made: dict[str, str] = {}


def folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder below the shared one."""
    return f"{root_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is computed once: several readers share it, and its lineage ends there."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def version(spark: SparkSession, *paths: str) -> str:
    """What a source's files are: changes when one of them does (by name, length or time); no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths))
    rows = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).first()
    return f"{rows[0]}:{rows[1]}"


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def kept(spark: SparkSession, name: str, key: dict, make: Callable[[], DataFrame], seconds: float = KEEP) -> DataFrame:
    """The table that ``make`` gives for ``key`` (source versions, parameters), which is written once and read again for
    ``seconds``, by every session that shares the folder; then it is made anew.

    A table counts from the moment that its writer has finished; two writers at once each finish one, and the
    younger is read.  Expired ones go with ``clean``."""
    mark = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:32]
    home = f"{root_folder(spark)}/{KEPT}/{name}-{mark}"
    found = [(t, p) for t, p in _tables(spark, home) if time.time() - t < seconds]
    if not found:
        where = f"{home}/{uuid.uuid4().hex}"
        make().write.parquet(where)
        found = [(time.time(), where)]
    return spark.read.parquet(max(found)[1])


def _tables(spark: SparkSession, home: str) -> list[tuple[float, str]]:
    """(time of writing, path) of the finished tables below a folder."""
    files, path = _path(spark, home)
    if not files.exists(path):
        return []
    out = []
    for own in files.listStatus(path):
        done = spark._jvm.org.apache.hadoop.fs.Path(own.getPath(), "_SUCCESS")
        if files.exists(done):
            out.append((files.getFileStatus(done).getModificationTime() / 1000, own.getPath().toString()))
    return out


def clean(spark: SparkSession, seconds: float = KEEP) -> int:
    """Removes kept tables that were written more than ``seconds`` ago; says how many.  Readers of them must be over."""
    files, path = _path(spark, f"{root_folder(spark)}/{KEPT}")
    gone = 0
    for home in files.listStatus(path) if files.exists(path) else []:
        for written_at, where in _tables(spark, home.getPath().toString()):
            if time.time() - written_at >= seconds:
                gone += files.delete(spark._jvm.org.apache.hadoop.fs.Path(where), True)
    return gone

"""What several operators share: shared folders, Arrow columns as flat bytes, hashed words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken) -> str:
    """``name``, with underscores appended until no column of ``taken`` has it, whatever the case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


#: Bytes of text for each task that packed entries are dealt to.
DEAL_BYTES = 14 << 20


def deal(df: DataFrame, text: str) -> int:
    """Tasks to deal what is found in a text column to: in proportion to its bytes, which are summed first."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(12, -(-total // DEAL_BYTES))


def text_of(name: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


# ---- Arrow columns as flat arrays -------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying the bytes; a null is empty."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    places = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, one row at least."""
    places = flat(batch.column(column))[1]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(places, places[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def gather(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of text: small ones are joined, large ones cut."""
    held, size = [], 0
    for batch in batches:
        for piece in pieces(batch, column, limit):
            held.append(piece)
            size += len(flat(piece.column(column))[0])
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def by_offsets(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[places[1:]] - total[places[:-1]]


# ---- hashing ----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, for arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers of a stream named by ``seed``."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(0x9E3779B97F4A7C15) * (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)))


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z count as a-z."""
    table = seeds(256, seed)
    if lower:
        table[65:91] = table[97:123]
    return table


POWER = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, POWER, np.uint64)]))
    return _powers[:n]


def spans(data: np.ndarray, places: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that ``inside`` (bool[256]) holds, never across documents: starts, ends, offsets by document."""
    own = inside[data]
    n = len(own)
    begins = np.zeros(n + 1, bool)
    begins[places] = True
    first = own.copy()
    first[1:] &= ~own[:-1] | begins[1:n]
    last = own.copy()
    last[:-1] &= ~own[1:] | begins[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, places)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *tables: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the byte ranges, one array for each table of byte values."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in tables]
    length = (ends - starts).astype(np.int64)
    at = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1], out=at[1:])
    place = np.arange(int(length.sum()), dtype=np.int32 if length.sum() < 2**31 else np.int64)
    own = data[place + np.repeat((starts - at).astype(place.dtype), length)]
    weight = powers(int(length.max()))[place - np.repeat(at.astype(place.dtype), length)]
    with np.errstate(over="ignore"):
        return [mix(np.add.reduceat(t[own] * weight, at) + length.astype(np.uint64)) for t in tables]


def in_runs(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k, w in enumerate(seeds(size, 77)):
            total += values[k : k + n] * (w | np.uint64(1))
        return mix(total)


#: Bytes of words that ASCII white space bounds.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of lower-cased words of letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of lines.
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False


def distinct_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of fewer words, the whole sequence; none of none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(in_runs(words, min(size, len(words))))


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, work: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches of 16 MB at most, unless the session asks for less: texts are long."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(ARROW_BYTES)) or 0) == 64 << 20:  # Spark's default
        conf.set(ARROW_BYTES, str(16 << 20))
    return df.mapInArrow(work, schema)

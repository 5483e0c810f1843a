"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id, row number), so equal texts stand together.
Splitters for shards of near equal bytes are found by counting exact bytes below candidate keys: the
first round probes 2^12 even boundaries, each further round 2^8 boundaries inside the intervals that
hold an unmet target, until an interval is lighter than the tolerance or a single row.  A round is
one map-side aggregation; its counts, at most (shards - 1) * 2^8, are all that the driver reads.
A boundary lies between groups of equal texts unless a group alone outweighs the tolerance; then the
probing goes on inside the group.  Rows are exchanged once, to their slots.

Slots: each shard is dealt into buckets by row number; a bucket's offset is the sum of the counts
before it, so no task numbers a whole shard.

Rows: a null text has no bytes and the CRC of no bytes, 0; null ids are hashed like any value;
repeated rows are told apart by row number.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

SHARDS = 40
#: Bytes that a splitter may miss its target by, as a part of a shard.
TOLERANCE = 0.001
#: Rows of a bucket, about.
BUCKET = 4000
FIRST_BITS, MORE_BITS = 12, 8
KEYS = ("k1", "k2", "k3")


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple]:
    """Lower bounds (k1[, k2[, k3]]) of shards 1 to ``shards`` - 1, in order."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = total / shards * tolerance
    found: dict[int, tuple] = {}
    #: (keys fixed so far, bits and value of the key being probed, bytes below): targets
    todo = {((), 0, 0, 0): [k for k in range(1, shards)]}
    while todo and total:
        depth = min(len(fixed) for fixed, *_ in todo)
        here = {x: t for x, t in todo.items() if len(x[0]) == depth}
        bits = min(b for _, b, _, _ in here)
        here = {x: t for x, t in here.items() if x[1] == bits}
        new = min(64, bits + (MORE_BITS if bits else FIRST_BITS))
        key = KEYS[depth]
        inside = F.lit(False)
        for fixed, b, value, _ in here:
            own = F.lit(True)
            for name, v in zip(KEYS, fixed):
                own = own & (F.col(name) == v)
            if b:
                own = own & (F.shiftright(key, 64 - b) == value)
            inside = inside | own
        rows = keys.where(inside).groupBy(*KEYS[:depth], F.shiftright(key, 64 - new).alias("probe")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        for place, targets in here.items():
            fixed, b, value, below = place
            del todo[place]
            own = sorted((r["probe"], r["bytes"], r["n"]) for r in rows if all(r[k] == v for k, v in zip(KEYS, fixed)) and (not b or r["probe"] >> (new - b) == value))
            at = 0
            for k in targets:
                want = total * k / shards
                while at + 1 < len(own) and below + own[at][1] <= want:
                    below += own[at][1]
                    at += 1
                probe, weight, n = own[at]
                if weight <= slack or n == 1 or (new == 64 and depth + 1 == len(KEYS)):
                    bound = probe << (64 - new) if want - below <= below + weight - want else None
                    if bound is None:  # the upper edge is nearer: the next key that occurs, or no more of this value
                        bound = own[at + 1][0] << (64 - new) if at + 1 < len(own) else (probe + 1) << (64 - new)
                    found[k] = (*fixed, bound)
                elif new < 64:
                    todo.setdefault((fixed, new, probe, below), []).append(k)
                else:
                    todo.setdefault(((*fixed, probe), 0, 0, below), []).append(k)
    return [found[k] for k in sorted(found)]


def at_least(bound: tuple):
    """Rows whose key isn't below ``bound``; a bound over the largest 64-bit value is above all."""
    test = None
    for name, v in reversed(list(zip(KEYS, bound))):
        above = F.lit(False) if v >= 1 << 63 else F.col(name) > v
        equal = F.lit(False) if v >= 1 << 63 else F.col(name) == v
        test = (above | equal) if test is None else above | (equal & test)
    return test


def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, size, text_crc32, shard, slot): near equal bytes in every shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    keys = C.materialise(docs.select(
        F.col(key), (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("k1"), F.xxhash64(F.col(key), F.lit("shard")).alias("k2"), F.monotonically_increasing_id().alias("k3"),
    ), "keys")
    bounds = splitters(keys, shards, tolerance)
    number = F.lit(0)
    for bound in bounds:
        number = number + at_least(bound).cast("int")
    buckets = max(8, -(-keys.count() // (shards * BUCKET)))
    placed = keys.select("*", number.alias("shard"), F.pmod(F.xxhash64("k3"), F.lit(buckets)).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("k1", "k2", "k3"))
    return placed.join(offsets, ["shard", "bucket"]).select(key, "size", "text_crc32", "shard", (F.col("before") + own - 1).alias("slot"))


def op5_histogram_sort(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Packing of tokenised documents into sequences: shortest-pack-first over the length histogram.

1. Each document becomes token ids plus an end id and is cut into pieces of at most ``size`` tokens;
   each task numbers its pieces of every length from 0 and the pieces are written once.
2. The histogram has ``size`` lengths at most, so the plan is made on the driver whatever the corpus:
   lengths are placed longest first, each into the packs with most room (the shortest), as counts of
   identical packs ("patterns"), never pack by pack.
3. A piece's rank among the pieces of its length (its task's offset plus its number there) says which
   copy of which pattern takes it, hence its sequence and its offset there.

Rows: a null or empty text is the end id alone, one piece of one token.  Documents longer than
``size`` fill whole sequences and leave a remainder.  Repeated rows are packed each for itself.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

SIZE = 2048
END = 1
SPECIAL = "<|endoftext|>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE vocabulary (a ``tokenizers`` file) as an array of little-endian uint32.

    ``tiktoken`` gives the same ids several times faster from the file's own vocabulary; the text of
    the special token, which ``tokenizers`` takes for that token, is cut out first."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows the other bytes as 256 and up
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.special = vocabulary.pop(SPECIAL, 50256)
        ranks = {bytes(byte[c] for c in word): k for word, k in vocabulary.items()}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            return self.encode(text, disallowed_special=())
        parts = []
        for own in text.split(SPECIAL):
            parts += [self.encode(own, disallowed_special=()), np.array([self.special], "<u4")]
        return np.concatenate(parts[:-1])


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, number): the pieces; number counts a task's pieces of that length."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()

    def work(frames):
        encode, task = Encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        end = np.array([END], "<u4")
        for frame in frames:
            out = []
            for doc, own in zip(frame["key"], frame["text"], strict=True):
                ids = np.append(encode(own), end) if own else end
                total = len(ids)
                for start in range(0, total, size):
                    length = min(size, total - start)
                    out.append((doc, start, length, zlib.crc32(ids[start : start + length]), total, task, int(seen[length])))
                    seen[length] += 1
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"]).astype({"doc_id": object})

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, number bigint"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(work, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: [(copies, [(length, times), ...])] with the lengths of a pattern longest first.

    Open packs are kept by room.  For each length, longest first, the packs with most room take it:
    as many times as it fits if copies are plenty, else once; a pattern is split where only some of
    its copies take the length."""
    open_packs: dict[int, list] = {}
    done = []
    rooms: list[int] = []

    def keep(room, copies, parts):
        if room == 0:
            done.append((copies, parts))
            return
        if room not in open_packs:
            open_packs[room] = []
            heappush(rooms, -room)
        open_packs[room].append((copies, parts))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not open_packs.get(-rooms[0]):
                open_packs.pop(-heappop(rooms), None)
            room = -rooms[0] if rooms else 0
            if room < length:  # no open pack takes it: new ones
                times = min(size // length, left)
                copies = left // times
                keep(size - times * length, copies, [(length, times)])
                left -= times * copies
                continue
            copies, parts = open_packs[room].pop()
            times = min(max(1, room // length), left)
            take = min(copies, left // times)
            if take < copies:
                open_packs[room].append((copies - take, parts))
            keep(room - times * length, take, [*parts, (length, times)])
            left -= times * take
    return done + [x for packs in open_packs.values() for x in packs]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times, first sequence, offset) in order of rank."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for copies, parts in patterns:
        at = 0
        for length, times in parts:
            first = used.get(length, 0)
            found.setdefault(length, []).append((first, times, sequence, at))
            used[length] = first + times * copies
            at += times * length
        sequence += copies
    return {k: np.array(v, np.int64) for k, v in found.items()}


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (of ``cut``, written once) with sequence_id and offset."""
    counts = cut_pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    table = cut_pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, size)))
    kept = [c for c in cut_pieces.columns if c not in ("task", "number")]
    ranked = cut_pieces.join(before, ["task", "length"]).select(*kept, (F.coalesce("before", F.lit(0)) + F.col("number")).alias("rank"))

    def work(frames):
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                own = order[a:b]
                spans = table.value[int(length[own[0]])]
                at = np.searchsorted(spans[:, 0], rank[own], "right") - 1
                first, times, base, place = spans[at].T
                sequence[own] = base + (rank[own] - first) // times
                offset[own] = place + (rank[own] - first) % times * length[own]
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInPandas(work, f"{fields}, sequence_id bigint, offset bigint")


def op4_spfhp_packing(spark, sf_dir: str) -> DataFrame:
    return packing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(C.materialise(cut(docs), "pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

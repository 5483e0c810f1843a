"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent lengths, worker caches for the rest.

A BPE model whose pieces hold the space mark at their start only (or are space marks alone) never merges
over the start of a run of spaces, nor over a byte that no piece holds.  A text's token count is thus the
sum over its pre-tokens, each a run of spaces and what follows it, and each line break by itself.

1. Every task counts its pre-tokens of at most 16 bytes and keeps the ``FREQUENT`` commonest of them as
   one packed row; packed rows are merged 32 to a task until 32 are left.  All rows are read.  The table
   only decides what is found fast, never a count.
2. The driver encodes these once.  The broadcast table has open addressing over exact 16-byte keys
   (padded with a byte that UTF-8 never has): 17 bytes a slot, 2 * FREQUENT slots, whatever the corpus.
3. Tasks look all pre-tokens up side by side; what misses goes through a cache of the worker's process
   (two generations of ``CACHED`` entries, kept from task to task) and is encoded there, once.

Rows: a null or empty text has no bytes and no tokens.  Repeated rows are counted each for itself.
Texts of any length are counted whole; pre-tokens over 64 bytes are encoded without being cached.
An empty table gives no rows.  Columns that share a name with a new one keep it; the new one gets underscores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

#: Pre-tokens in the broadcast table, and entries of one generation of a worker's cache.
FREQUENT, CACHED = 1 << 14, 1 << 18
#: Bytes of a key of the table, and of the longest pre-token that a cache holds.
KEY, CACHE_BYTES = 16, 64
#: Packed rows merged in one task.
FAN = 32
LIMIT = 4096
SPACE, BREAK = 32, 10
MARK = "▁".encode()

_PAD = np.array([~((1 << 8 * k) - 1) & C.MASK for k in range(9)], np.uint64)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    """Token counts of single pre-tokens by the library itself."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule, kind = model.normalizer_spec, model.trainer_spec
        mark = MARK.decode()
        whole = [p.piece for p in model.pieces if (mark in p.piece[1:] and p.piece.strip(mark)) or "\n" in p.piece]
        if rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or not rule.escape_whitespaces or kind.model_type != kind.BPE or whole:
            raise ValueError("counts by pre-token need a BPE model that keeps texts as they are and merges nothing across spaces or line breaks")
        self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        self.opening = len(self.encode("\n"))  # the mark before a text, and the line break
        self.line_break = self.opening - 1

    def __call__(self, words: list[bytes]) -> list[int]:
        """Tokens of each pre-token.  The library puts a space before every text: one is taken off, or, where
        there is none, a line break is put first and what it adds taken off."""
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = self.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        return [1 if t == " " else len(i) - (0 if t[0] == " " else self.opening) for t, i in zip(texts, ids)]


def pretokens(data: np.ndarray, places: np.ndarray):
    """(bytes with a space before each text, starts, ends, offsets by text)."""
    own = np.diff(places) > 0
    data = np.insert(data, places[:-1][own], SPACE)
    places = places + np.concatenate([[0], np.cumsum(own)])
    space, line = data == SPACE, data == BREAK
    start = space | line
    start[1:] &= ~(space[1:] & space[:-1])
    start[1:] |= line[:-1]
    start[places[:-1][own]] = True
    starts = np.flatnonzero(start)
    return data, starts, np.append(starts[1:], len(data)).astype(np.int64)[: len(starts)], np.searchsorted(starts, places)


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each range as two numbers, padded with 255."""
    held = np.concatenate([data, np.full(2 * KEY, 255, np.uint8)])
    eight = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))
    length = ends - starts
    return eight[starts] | _PAD[np.minimum(length, 8)], eight[starts + 8] | _PAD[np.clip(length - 8, 0, 8)]


def mark_free(column: pa.Array) -> pa.Array:
    """Space marks that stand in a text count as spaces, as they do for the library."""
    data = C.flat(column)[0]
    if len(data) > 2 and ((data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])).any():
        return pc.replace_substring(column, MARK, b" ")
    return column


# ---- the frequent pre-tokens ------------------------------------------------------------------


def _summed(low: np.ndarray, high: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` keys of greatest count, counts of equal keys added."""
    order = np.lexsort((high, low))
    low, high, n = low[order], high[order], n[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return low, high, n
    n = np.add.reduceat(n, at)
    top = np.argsort(-n, kind="stable")[:most]
    return low[at][top], high[at][top], n[top]


def _packed(low, high, n) -> bytes:
    return np.concatenate([low, high, n.astype(np.uint64)]).tobytes()


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    parts = [np.frombuffer(b, np.uint64).reshape(3, -1) for b in blobs]
    low, high, n = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.uint64)
    return [low, high, n.astype(np.int64)]


def frequent(docs: DataFrame, text: str = "text", most: int = FREQUENT) -> list[bytes]:
    """The commonest pre-tokens of at most 16 bytes over all rows, by merged counts of the tasks' commonest."""

    def count(batches):
        held, size = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)], 0
        for batch in batches:
            for piece in C.pieces(batch, "text", 2 << 20):
                data, starts, ends, _ = pretokens(*C.flat(mark_free(piece.column("text"))))
                short = (ends - starts <= KEY) & (data[starts] != BREAK)
                low, high = keys(data, starts[short], ends[short])
                own = C.mix(low ^ C.mix(high))
                _, first, n = np.unique(own, return_index=True, return_counts=True)
                held = list(_summed(*(np.concatenate(x) for x in zip(held, (low[first], high[first], n))), 4 * most))
                size += 1
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(*_summed(*held, most))], pa.binary())], ["packed"])

    def merge(batches):
        held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for batch in batches:
            for blob in batch.column("packed").to_pylist():
                held = list(_summed(*(np.concatenate(x) for x in zip(held, _unpacked([blob]))), most))
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array([_packed(*held)], pa.binary())], ["packed"])

    found = C.materialise(C.mapped(docs.select(C.text_of(text).alias("text")), count, "packed binary"), "frequent")
    n = found.count()
    while n > FAN:
        n = -(-n // FAN)
        found = C.materialise(found.repartition(n).mapInArrow(merge, "packed binary"), "frequent")
    low, high, _ = _summed(*_unpacked([r[0] for r in found.collect()]), most)  # FAN rows of a fixed size at most
    raw = np.stack([low, high], axis=1).tobytes()
    return [raw[at : at + KEY].rstrip(b"\xff") for at in range(0, len(raw), KEY)]


class Lengths:
    """Open addressing over 16-byte keys: ``low``, ``high`` and the token count of each slot, 0 where it is free."""

    def __init__(self, words: list[bytes], counts: list[int]):
        size = 1 << max(4, (2 * len(words) - 1).bit_length())
        self.low, self.high, self.n = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        low, high = keys(data, ends - [len(w) for w in words], ends) if words else (self.low[:0], self.high[:0])
        for a, b, at, n in zip(low, high, self.home(low, high), counts):
            while self.n[at]:
                at = (at + 1) % size
            self.low[at], self.high[at], self.n[at] = a, b, n

    def home(self, low, high) -> np.ndarray:
        return (C.mix(low ^ C.mix(high)) & np.uint64(len(self.n) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Token counts; 0 where the key isn't there."""
        out, at, open_ = np.zeros(len(low), np.int64), self.home(low, high), np.arange(len(low))
        while len(open_):
            own = at[open_]
            hit = (self.low[own] == low[open_]) & (self.high[own] == high[open_])
            out[open_[hit]] = self.n[own[hit]]
            open_ = open_[~hit & (self.n[own] > 0)]
            at[open_] = (at[open_] + 1) & (len(self.n) - 1)
        return out


# ---- counting ---------------------------------------------------------------------------------


class Cache:
    """Counts of pre-tokens seen by this process: two generations, the older one dropped when the younger is full."""

    def __init__(self, encode: Callable[[list[bytes]], list[int]]):
        self.encode, self.young, self.old = encode, {}, {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        new, now = [], {}
        for w in set(words):
            n = self.young.get(w) or self.old.get(w)
            if n is None:
                new.append(w)
            else:
                now[w] = n
        for at in range(0, len(new), 4096):
            now.update(zip(new[at : at + 4096], self.encode(new[at : at + 4096])))
        for w in now:
            if len(w) <= CACHE_BYTES:
                if len(self.young) >= CACHED:
                    self.young, self.old = {}, self.young
                self.young[w] = now[w]
        return np.fromiter((now[w] for w in words), np.int64, len(words))


_caches: dict[str, Cache] = {}


def worker_cache(path: str) -> Cache:
    """The process's cache for a model, which later tasks in it use again."""
    if path not in _caches:
        _caches[path] = Cache(Encoder(path))
    return _caches[path]


def text_tokens(data: np.ndarray, places: np.ndarray, lengths: Lengths, cache: Cache) -> np.ndarray:
    """Tokens of each text."""
    data, starts, ends, at = pretokens(data, places)
    n = np.where(data[starts] == BREAK, cache.encode.line_break, 0)
    short = np.flatnonzero((ends - starts <= KEY) & (n == 0))
    n[short] = lengths.find(*keys(data, starts[short], ends[short]))
    missed = np.flatnonzero(n == 0)
    raw = data.tobytes()
    n[missed] = cache.counts([raw[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist())])
    return C.by_offsets(n, at)


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None, limit: int = LIMIT, most: int = FREQUENT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) appended."""
    path = model or default_model()
    words = frequent(docs, text, most)
    shared = docs.sparkSession.sparkContext.broadcast(Lengths(words, Encoder(path)(words) if words else []))
    raw = C.fresh("raw_text", docs.columns)
    names = list(docs.columns)
    for name in ("n_bytes", "n_tokens", "over_limit"):
        names.append(C.fresh(name, names))
    kinds = (T.LongType(), T.LongType(), T.BooleanType())

    def work(batches):
        cache, lengths = worker_cache(path), shared.value
        for batch in batches:
            for piece in C.pieces(batch, raw, 2 << 20):
                size = np.diff(C.flat(piece.column(raw))[1])
                n = text_tokens(*C.flat(mark_free(piece.column(raw))), lengths, cache)
                columns = [*piece.drop_columns([raw]).columns, pa.array(size.astype(np.int64)), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names[-3:], kinds))])
    return C.mapped(docs.withColumn(raw, C.text_of(text)), work, schema)


def op13_two_tier_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")

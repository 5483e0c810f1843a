"""Language identification by prediction by partial matching (PPM).

For each language, contexts of 0 to ``order`` bytes hold how often each byte followed them, from the first
time on.  A byte costs ``-log2 c/(T+q)`` in the longest known
context where it was seen (``T`` bytes seen there, ``q`` different ones); where it wasn't, an escape
``-log2 q/(T+q)`` and what the next shorter context asks; below order 0, 8 bits.  Statistics are frozen
before scoring, so a text's code length is exact and the same wherever it is computed.  The language of
the shortest code wins.

Fitting reads a bounded sample of the labelled rows (``fit_docs`` documents of each language in
expectation, chosen by a hash), each of them whole; counts are summed per task, then by Spark.  Every
counted byte string is in the model, as sorted arrays: 12 bytes each, which the sample bounds.  Scoring
covers all bytes of all rows; a task looks up each different byte string of its texts once.

The posterior is the winner's share of ``2^-bits`` over the whole text, as its exact code lengths give it; of all
but short texts it is 1, as bytes of a text are no independent witnesses.  The score is the same share with the bits
of ``EVIDENCE`` bytes of the text at most, at its mean cost; the pipeline's threshold takes this one.

Rows: null or letterless texts get ``und`` and score and posterior 0, as does everything where no row can be
learned from.  Languages that tie go to the smaller name.  Repeated rows are scored alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

ORDER = 3
#: Documents of each language that the counts are taken from, in expectation.
FIT_DOCS = 4000
#: Bytes that a score takes as evidence at most.
EVIDENCE = 16
#: The least score of a document that the pipeline keeps.
CLEAR = 0.4
LETTER = re.compile(r"[^\W\d_]")


def counts(sample: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, n): grams of 1 to order+1 bytes as big-endian numbers; texts start after zero bytes."""

    def work(batches):
        for batch in C.gather(batches, text, 4 << 20):
            data, places = C.flat(batch.column(text))
            langs = np.array(batch.column(lang).to_pylist(), object)
            out = []
            for name in sorted(set(langs)):
                parts = []
                for i in np.flatnonzero(langs == name):
                    parts += [np.zeros(order, np.uint8), data[places[i] : places[i + 1]]]
                own = np.concatenate(parts).astype(np.uint64)
                fresh = np.concatenate([np.arange(len(p)) < order if not k % 2 else np.zeros(len(p), bool) for k, p in enumerate(parts)])
                gram = np.zeros(len(own), np.uint64)
                for size in range(1, order + 2):
                    gram |= np.concatenate([np.zeros(size - 1, np.uint64), own[: len(own) - size + 1]]) << np.uint64(8 * (size - 1))
                    value, n = np.unique(gram[~fresh], return_counts=True)
                    out.append(pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(np.full(len(value), size, np.int32)), pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "size", "gram", "n"]))
            yield from out

    return C.mapped(sample, work, "lang string, size int, gram bigint, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen statistics: for each language and context length, sorted contexts with what an escape costs,
    and sorted byte strings (context and byte) with their cost."""

    def __init__(self, langs: list[str], grams: dict[str, list], order: int = ORDER):
        """``grams``: by language and context length, {byte string as a big-endian number: count}, or two arrays of these."""
        self.langs, self.order = langs, order
        self.tables = [[self._table(length, grams[name][length]) for length in range(order + 1)] for name in langs]

    @staticmethod
    def _table(length: int, counted):
        gram, n = (np.fromiter(x, np.int64, len(counted)) for x in (counted.keys(), counted.values())) if isinstance(counted, dict) else counted
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        context, first = np.unique(gram >> 8, return_index=True)
        if not len(gram):
            return context, np.zeros(0, np.float32), gram, np.zeros(0, np.float32)
        total, q = np.add.reduceat(n, first), np.diff(np.append(first, len(gram)))
        cost = np.log2(np.repeat(total + q, q) / n)
        return context, np.log2((total + q) / q).astype(np.float32), gram, cost.astype(np.float32)

    def nbytes(self) -> int:
        return sum(x.nbytes for tables in self.tables for table in tables for x in table)

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of ``order`` + 1 bytes, a column for each language."""
        out = np.zeros((len(gram), len(self.langs)))
        for k, tables in enumerate(self.tables):
            open_ = np.arange(len(gram))
            for length in range(self.order, -1, -1):
                contexts, escape, strings, cost = tables[length]
                own = gram[open_] & ((1 << 8 * (length + 1)) - 1)
                if len(strings):
                    at = np.minimum(np.searchsorted(strings, own), len(strings) - 1)
                    seen = strings[at] == own
                    out[open_[seen], k] += cost[at[seen]]
                    open_, own = open_[~seen], own[~seen]
                    at = np.minimum(np.searchsorted(contexts, own >> 8), len(contexts) - 1)
                    known = contexts[at] == own >> 8
                    out[open_[known], k] += escape[at[known]]
            out[open_, k] += 8.0
        return out

    def bits(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Code lengths in bits, one row for each text and a column for each language."""
        out = np.zeros((len(places) - 1, len(self.langs)))
        if not len(data):
            return out
        gram = data.astype(np.int64 if self.order > 2 else np.int32)
        for back in range(1, self.order + 1):
            before = np.zeros(len(data), gram.dtype)
            before[back:] = data[:-back]
            for k in range(back):  # nothing reaches over the start of a text
                at = places[:-1] + k
                before[at[at < places[1:]]] = 0
            gram |= before << (8 * back)
        if self.order == 3:
            gram = gram.astype(np.uint32)
        different, own = np.unique(gram, return_inverse=True)
        costs = self.costs(different.astype(np.int64))
        for k in range(len(self.langs)):
            total = np.zeros(len(data) + 1)
            np.cumsum(costs[own, k], out=total[1:])
            out[:, k] = total[places[1:]] - total[places[:-1]]
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", learn=None, fit_docs: int = FIT_DOCS, order: int = ORDER) -> Model:
    """Counts over the sample; ``learn`` says which rows may be learned from (all with a language, by default)."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    share = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    if not share:
        return Model([], {}, order)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    want = F.lit(0.0)
    for name, n in share.items():
        want = F.when(F.col(lang) == name, min(1.0, fit_docs / n)).otherwise(want)
    sample = rows.where(draw < want).select(F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang"))
    found = C.materialise(counts(sample, "text", "lang", order), "counts")
    grams = {}
    for name in sorted(share):  # one language's counts at a time; the sample bounds them
        own = found.where(F.col("lang") == name).select("size", "gram", "n").toArrow()
        size, gram, n = (own.column(c).to_numpy() for c in ("size", "gram", "n"))
        if len(size):
            grams[name] = [(gram[size == k], n[size == k]) for k in range(1, order + 2)]
    return Model(sorted(grams), grams, order)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score, posterior, bits) appended, which the module describes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = C.fresh("raw_text", docs.columns)
    name = C.fresh(out, docs.columns)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("posterior", T.DoubleType()), T.StructField("bits", T.DoubleType())])

    def work(batches):
        model = shared.value
        for batch in batches:
            for piece in C.pieces(batch, raw, 2 << 20):
                data, places = C.flat(piece.column(raw))
                n = len(piece)
                pred, score, whole, best = np.array(["und"] * n, object), np.zeros(n), np.zeros(n), np.zeros(n)
                if model.langs:
                    bits = model.bits(data, places)
                    win = bits.argmin(axis=1)
                    best = bits[np.arange(n), win]
                    weight = np.minimum(1, EVIDENCE / np.maximum(np.diff(places), 1))
                    behind = np.minimum(best[:, None] - bits, 0)
                    share, posterior = (1 / np.exp2(x).sum(axis=1) for x in (behind * weight[:, None], behind))
                    for i in range(n):
                        if LETTER.search(data[places[i] : places[i + 1]].tobytes().decode("utf-8", "replace")):
                            pred[i], score[i], whole[i] = model.langs[win[i]], share[i], posterior[i]
                struct = pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.array(whole), pa.array(best)], ["lang_pred", "score", "posterior", "bits"])
                yield C.with_column(piece.drop_columns([raw]), name, struct)

    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    return C.mapped(docs.withColumn(raw, C.text_of(text)), work, schema)


def held_out(key: str = "doc_id"):
    """Rows that nothing is learned from: the key's CRC-32 leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def op9_language_ppm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, learn=~held_out())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.posterior")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (``und``) and those where no language scores ``CLEAR``."""
    model = fit(docs, learn=~held_out())
    found = identify(docs, model)
    name = found.columns[-1]
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= CLEAR)).select(*docs.columns)

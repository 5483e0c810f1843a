"""Quality rules: cross-document line frequency.

Every line with a word is normalised (white space collapsed, A-Z lower-cased) and hashed to 64 bits;
a host's documents that hold it are counted, map-side first.  Lines in more than ``max_docs``
documents of one host are removed, and a document that keeps less than ``least`` of its words that
way is depleted and rejected, as are those that fail the base rules.

Frequent lines meet their documents again in a sort-merge join, which Spark splits where a line is
hot; per document only sums return.  The measured table (no text) is written once with a row number,
so that rows are told apart whatever their ids.

Rows: a null or empty text has no words and fails the base rules.  A null host is a host of its own
with the empty one.  Each row counts as a document: repeated rows count again, and get equal verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

MAX_DOCS = 20
LEAST = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
EXACT, LOWER = C.byte_table(2), C.byte_table(3, lower=True)


def _repeats(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more in their document, and which have an equal one before them."""
    with np.errstate(over="ignore"):
        own = C.mix(keys + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def line_words(data: np.ndarray, places: np.ndarray):
    """Words and lines of flat texts: everything that the measures and the cleaning share."""
    starts, ends, at = C.spans(data, places, C.NOT_SPACE)
    exact, lower = C.hashes(data, starts, ends, EXACT, LOWER)
    begin, end, line_at = C.spans(data, places, C.NOT_NEWLINE)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    count = last - first
    has = count > 0
    normal = np.zeros(len(begin), np.uint64)
    if has.any():
        place = np.arange(len(starts)) - np.repeat(first[has], count[has])
        with np.errstate(over="ignore"):
            normal[has] = C.mix(np.add.reduceat(lower * C.powers(int(count.max()))[place], first[has]) + count[has].astype(np.uint64))
    doc = np.searchsorted(line_at, np.arange(len(begin)), "right") - 1
    return exact, at, begin, end, doc, count, normal


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the base measures and ``lines``: (hash, words) of each different line.

    These come last, in this order; one whose name a column has gets underscores appended."""
    raw = C.fresh("raw_text", docs.columns)
    kept = [c for c in docs.columns if c != text]
    numbers = [C.fresh(n, kept) for n in NUMBERS]
    line_name = C.fresh("lines", kept)
    rows = docs.select(*kept, C.text_of(text).alias(raw))
    kind = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("words", T.LongType())]))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, T.LongType()) for n in numbers), T.StructField(line_name, kind)])

    def work(batches):
        for batch in batches:
            for piece in C.pieces(batch, raw, 3 << 20):
                data, places = C.flat(piece.column(raw))
                exact, at, begin, end, doc, count, normal = line_words(data, places)
                n = len(piece)
                lead = C.NOT_SPACE[data] & ((data & 0xC0) != 0x80)
                owner = np.repeat(np.arange(n), np.diff(at))
                windows = C.in_runs(exact, 3)
                inside = owner[: len(windows)] == owner[2:][: len(windows)]
                twice = np.zeros(len(windows), bool)
                twice[inside] = _repeats(windows[inside], owner[: len(windows)][inside])[0]
                mark = np.zeros(len(exact), bool)
                for k in range(3):
                    mark[k : k + len(windows)] |= twice
                has = np.flatnonzero(count > 0)
                dup = np.zeros(len(begin), bool)
                dup[has] = _repeats(C.hashes(data, begin[has], end[has], EXACT)[0], doc[has])[1]
                order = has[np.lexsort((normal[has], doc[has]))]
                new = np.ones(len(order), bool)
                new[1:] = (normal[order][1:] != normal[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                first = np.flatnonzero(new)
                words = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
                struct = pa.StructArray.from_arrays([pa.array(normal[order][first].view(np.int64)), pa.array(words.astype(np.int64))], ["hash", "words"])
                lines = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order][first], np.arange(n + 1)).astype(np.int32)), struct)
                sums = [np.diff(at), C.by_offsets(lead, places), C.by_offsets(SYMBOLS[data], places), np.bincount(doc[dup], minlength=n), C.by_offsets(mark, at)]
                yield pa.RecordBatch.from_arrays([*piece.drop_columns([raw]).columns, *(pa.array(x.astype(np.int64)) for x in sums), lines], names=[*kept, *numbers, line_name])

    return C.mapped(rows, work, schema)


def frequent_lines(measured: DataFrame, host: str, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, hash, n_docs) of the lines above the limit."""
    lines = measured.select(F.coalesce(host, F.lit("")).alias("host"), F.explode("lines").alias("l")).select("host", "l.hash")
    return lines.groupBy("host", "hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, least: float = LEAST) -> DataFrame:
    """Base measures, n_removed_words, base_failed and kept for each row, after its other columns but the
    text; a measure whose name a column has gets underscores appended."""
    number = C.fresh("row_number", docs.columns)
    own = measure(docs.withColumn(number, F.monotonically_increasing_id()), text)
    table = C.materialise(own, "lines")
    n_words, _, _, _, n_repeat, lines = (F.col(c) for c in table.columns[-6:])
    each = table.select(number, F.coalesce(host, F.lit("")).alias("host"), F.explode(lines).alias("l")).select(number, "host", "l.hash", "l.words")
    frequent = each.groupBy("host", "hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    gone = C.fresh("n_removed_words", table.columns)
    removed = each.join(frequent.drop("n_docs"), ["host", "hash"]).groupBy(number).agg(F.sum("words").alias(gone))
    failed = (n_words < 50) | (n_repeat * 100 > n_words * 50)
    found = table.join(removed, number, "left").withColumn(gone, F.coalesce(gone, F.lit(0).cast("bigint")))
    depleted = n_words - F.col(gone) < n_words * least
    names = [C.fresh(x, table.columns) for x in ("base_failed", "kept")]
    return found.withColumns(dict(zip(names, (failed, ~failed & ~depleted)))).drop(number, table.columns[-1])


def clean(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, least: float = LEAST) -> DataFrame:
    """``docs`` that pass, their frequent lines taken out of the text."""
    number, raw, lines = (C.fresh(x, docs.columns) for x in ("row_number", "raw_text", "frequent"))
    numbered = C.materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    table = C.materialise(measure(numbered.select(number, F.col(host).alias("host"), F.col(text).alias("text"))), "lines")
    each = table.select(number, F.coalesce("host", F.lit("")).alias("host"), F.explode("lines").alias("l")).select(number, "host", "l.hash", "l.words")
    removed = each.join(frequent_lines(table, "host", max_docs), ["host", "hash"]).groupBy(number).agg(F.sum("words").alias("words"), F.collect_list("hash").alias(lines))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    good = table.join(removed, number, "left").where(~failed & (F.col("n_words") - F.coalesce("words", F.lit(0)) >= F.col("n_words") * least)).select(number, lines)
    rows = numbered.join(good, number).select(*docs.columns, lines, C.text_of(text).alias(raw))
    names, at = docs.columns, docs.columns.index(text)

    def work(batches):
        for batch in batches:
            data, places = C.flat(batch.column(raw))
            _, _, begin, end, doc, count, normal = line_words(data, places)
            out = batch.column(text).to_pylist()
            for i, own in enumerate(batch.column(lines).to_pylist()):
                if own:
                    gone = set(own)
                    a, b = np.searchsorted(doc, [i, i + 1])
                    drop = {int(begin[k] - places[i]) for k in range(a, b) if count[k] and int(normal[k : k + 1].view(np.int64)[0]) in gone}
                    body, place, kept = data[places[i] : places[i + 1]].tobytes(), 0, []
                    for line in body.split(b"\n"):
                        if place not in drop:
                            kept.append(line)
                        place += len(line) + 1
                    out[i] = b"\n".join(kept).decode()
            columns = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return C.mapped(rows, work, docs.schema)


def op2_line_frequency(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM tri) WHERE c > 1
), marked AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid
), line AS (
  SELECT rid, host, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS l FROM d)
), real_line AS (
  SELECT rid, host, l, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM line WHERE len(lw) > 0
), dup AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n FROM real_line GROUP BY rid
), frequent AS (
  SELECT host, normal FROM real_line GROUP BY host, normal HAVING count(DISTINCT rid) > 20
), removed AS (
  SELECT rid, sum(n) AS n FROM real_line JOIN frequent USING (host, normal) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws) AS n_words,
    coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM w LEFT JOIN marked USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN removed USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_removed_words::BIGINT AS n_removed_words, base_failed,
  NOT base_failed AND NOT (n_words - n_removed_words < 0.5 * n_words) AS kept
FROM f
"""

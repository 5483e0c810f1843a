"""Audit of how the sources of a language differ: over-used terms of each source, and divergence of source pairs.

1. ``term_counts``: words are found and counted batch by batch (exact bytes, no hashes), with the number of
   documents; Spark adds these up by (lang, source, term).  A term in ``LEAST_DOCS`` documents of its
   language or more is kept.
2. ``shares``: p = 1 + floor(10^9 (count + 1) / (N + V)) for each group and each language.
3. Terms over their language's share are ranked by radix selection: rounds of histograms over ``BITS`` bits
   of the value, from the top, find each group's threshold; what lies above it is in, what lies below is out,
   what shares its digits goes on.  Equal values at the threshold go on by two bytes of UTF-8 a round, after
   the bytes that all of a group's candidates share, until what is left fits its places.  No group is sorted
   whole; only the ``ranks`` rows of each group are.
4. ``divergence``: nearly all terms are absent from nearly all sources, so a pair's sum starts from the
   baselines, p of a count of 0, and is corrected: sum(A, B) = sum over A's terms of f(p, base B) + sum over
   B's terms of f(base A, p) + (V - terms of A - terms of B) f(base A, base B) + for terms of both,
   f(p, q) - f(p, base B) - f(base A, q) + f(base A, base B).  The first sums need each source's histogram of
   shares and the different baselines only; the last meets the sources of each term once a pair, terms of many
   sources being dealt in blocks of ``BLOCK``.

All arithmetic is exact, in longs, or decimals where a product can leave them.

Rows: null text, lang and source count as empty strings, which are a language and a source like others.
Groups without terms take part in every pair.  A language without kept terms gives pairs of value 0 and no
terms; a language of one source gives no pairs.  Repeated rows count again.  An empty table gives no rows.
Other columns don't matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

LEAST_DOCS, RANKS = 3, 200
#: Bits of the value in a round of the radix selection.
BITS = 15
#: Candidates of a group that are ranked at once instead of in further rounds.
FEW = 4096
#: Sources of a term in a block, where pairs of sources meet.
BLOCK = 256
#: Bytes of text that are counted together before Spark adds up.
GATHER = 24 << 20
#: Bytes of words: letters A-Z, a-z and everything outside ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, as a written table."""

    def work(batches):
        for batch in C.gather(batches, "text", GATHER):
            data, places = C.flat(batch.column("text"))
            starts, ends, at = C.spans(data, places, LETTERS)
            if not len(starts):
                continue
            offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            body = LOWER[data[LETTERS[data]]]
            words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
            terms = len(words.dictionary)
            langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            _, first_of, of = np.unique(pair, return_index=True, return_inverse=True)
            owner = np.repeat(np.arange(len(batch)), np.diff(at))
            own, n = np.unique(owner * terms + words.indices.to_numpy(), return_counts=True)  # a term of a document
            both, first = np.unique(of[own // terms] * terms + own % terms, return_inverse=True)  # a term of a group
            row = pa.array(first_of[both // terms])
            yield pa.RecordBatch.from_arrays([
                batch.column("lang").take(row), batch.column("source").take(row), words.dictionary.take(pa.array(both % terms)),
                pa.array(np.bincount(first, n, len(both)).astype(np.int64)), pa.array(np.bincount(first, minlength=len(both)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    rows = docs.select(C.text_of(text).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"))
    found = C.mapped(rows, work, "lang string, source string, term string, n bigint, docs bigint")
    return C.materialise(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact whatever the counts."""
    many = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    wide = F.call_function("div", many, (total + kept).cast("decimal(20,0)"))
    return F.lit(1) + F.when(count < 9_000_000_000, F.call_function("div", (count + 1) * 1_000_000_000, total + kept)).otherwise(wide)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(docs: DataFrame, counts: DataFrame, least: int = LEAST_DOCS, lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(terms, groups), both written.  terms: (lang, source, term, p, q), the kept terms of each group with its and its
    language's share.  groups: (lang, source, v, n, base): kept terms of the language, the group's occurrences and the
    number of its kept terms (``own``), and p of a term that it hasn't; base is null where the language keeps no term."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = C.materialise(kept, "kept")
    known = C.materialise(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "known")
    of_group = known.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("own"))
    of_lang = kept.groupBy("lang").agg(F.sum("n_lang").alias("total"), F.count("*").alias("v"))
    every = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    groups = every.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "own", "v", "total"])
    groups = C.materialise(groups.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("n"), F.col("v")))), "groups")
    sized = known.withColumnRenamed("n", "count").join(groups, ["lang", "source"])
    terms = sized.select("lang", "source", "term", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("n_lang"), F.col("total"), F.col("v")).alias("q"))
    return C.materialise(terms, "terms"), groups


# ---- radix selection --------------------------------------------------------------------------


def _shared_bytes(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two binary columns."""
    step = lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), F.lit(0), step)


def _split(cand: DataFrame, digit: Column, falling: bool, keys: list[str]) -> DataFrame:
    """Candidates (with ``need``, the places left in their group) with ``state``: 1 for in, 0 for going on with the
    places that are left, -1 for out.  A group's threshold is the digit at which its histogram reaches ``need``."""
    own = cand.withColumn("digit", digit)
    hist = own.groupBy(*keys, "digit").agg(F.count("*").alias("here"), F.first("need").alias("places"))
    order = Window.partitionBy(*keys).orderBy(F.desc("digit") if falling else F.asc("digit"))
    reach = hist.withColumn("above", F.sum("here").over(order) - F.col("here")).where("above + here >= places")
    first = F.max_by if falling else F.min_by
    at = reach.groupBy(*keys).agg(first(F.struct("digit", (F.col("places") - F.col("above")).alias("left"), "here"), "digit").alias("edge"))
    at = C.materialise(at, "edges")  # a table of its own: small ones are broadcast, and a hot group's join can be split
    edge, beyond = F.col("edge.digit"), F.col("digit") > F.col("edge.digit") if falling else F.col("digit") < F.col("edge.digit")
    state = F.when(edge.isNull() | beyond, 1).when(F.col("digit") != edge, -1).when(F.col("edge.left") == F.col("edge.here"), 1).otherwise(0)
    return own.join(at, keys, "left").withColumn("state", state).withColumn("need", F.coalesce("edge.left", "need")).drop("digit", "edge")


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int = RANKS, few: int = FEW) -> DataFrame:
    """The ``k`` rows of each group with the greatest ``value`` (a long, 0 to 2^60), ties to the smaller ``item`` by its
    UTF-8 bytes, with ``rank`` from 1.  Rows are told apart by their items; equal pairs share places in any order."""
    names = rows.columns
    cand, done = C.materialise(rows.withColumn("need", F.lit(k).cast("bigint")), "candidates"), []

    def settle(split: DataFrame, name: str) -> DataFrame:
        split = C.materialise(split.where("state >= 0"), name)
        done.append(split.where("state = 1").select(*names))
        return split.where("state = 0").drop("state")

    most = cand.agg(F.max(value)).first()[0] or 0  # digits above it are 0 everywhere
    for shift in range(max(0, int(most).bit_length() - 1) // BITS * BITS, -1, -BITS):
        digit = F.shiftright(value, shift).bitwiseAND(F.lit((1 << BITS) - 1))
        cand = settle(_split(cand, digit, True, keys), f"value{shift}")
    cand = cand.withColumn("bytes", F.encode(item, "utf-8"))
    while not cand.isEmpty():  # equal values at the threshold
        size = cand.groupBy(*keys).agg(F.count("*").alias("size"), F.min("bytes").alias("a"), F.max("bytes").alias("b"))
        sized = C.materialise(cand.join(size.select(*keys, "size", _shared_bytes(F.col("a"), F.col("b")).alias("at")), keys), "ties")
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("bytes"))
        done.append(C.materialise(sized.where(F.col("size") <= few).withColumn("place", place).where("place <= need").select(*names), "small"))
        large = sized.where(F.col("size") > few)
        cand = settle(_split(large, F.substring("bytes", F.col("at") + 1, F.lit(2)), False, keys).drop("size", "at"), "bytes")
    found = reduce(DataFrame.unionByName, done)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item)))


def over_used(terms: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms over their language's share, the first ``ranks``."""
    rows = terms.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    return radix_top(rows, ["lang", "source"], "value", "item", ranks)


# ---- pairs of sources -------------------------------------------------------------------------


def _both(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, fix): what terms that both sources have add to the baseline sums, for each ordered pair."""
    own = terms.join(groups.select("lang", "source", "base"), ["lang", "source"]).select("lang", "term", "source", "p", "base")
    blocks = own.groupBy("lang", "term").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = own.join(blocks, ["lang", "term"], "left").na.fill(1, ["blocks"])
    left = dealt.withColumn("block", F.pmod(F.hash("source"), "blocks"))
    right = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = (t.select("lang", "term", "block", *(F.col(c).alias(n + c) for c in ("source", "p", "base"))) for t, n in ((left, "a_"), (right, "b_")))
    met = x.join(y, ["lang", "term", "block"]).where("a_source < b_source")
    p, q, bp, bq = (F.col(c) for c in ("a_p", "b_p", "a_base", "b_base"))
    fix = lambda p, q, bp, bq: excess(p, q) - excess(p, bq) - excess(bp, q) + excess(bp, bq)
    sums = met.groupBy("lang", "a_source", "b_source").agg(F.sum(fix(p, q, bp, bq)).alias("ab"), F.sum(fix(q, p, bq, bp)).alias("ba"))
    each = F.explode(F.array(F.struct(F.col("a_source").alias("a"), F.col("b_source").alias("b"), F.col("ab").alias("fix")), F.struct(F.col("b_source").alias("a"), F.col("a_source").alias("b"), F.col("ba").alias("fix"))))
    return sums.select("lang", each.alias("x")).select("lang", "x.*")


def divergence(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each ordered pair of sources of a language, by falling divergence."""
    hist = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    bases = groups.where("base IS NOT NULL").select("lang", "base").distinct()
    p, base, m = F.col("p"), F.col("base"), F.col("m")
    against = C.materialise(hist.join(bases, "lang").groupBy("lang", "source", "base").agg(F.sum(m * excess(p, base)).alias("to"), F.sum(m * excess(base, p)).alias("from_")), "against")
    a = groups.select("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), F.col("own").alias("own_a"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"), F.col("own").alias("own_b"))
    pairs = a.join(b, "lang").where(F.col("a") != F.col("b"))
    to = against.select("lang", F.col("source").alias("a"), F.col("base").alias("base_b"), "to")
    from_ = against.select("lang", F.col("source").alias("b"), F.col("base").alias("base_a"), "from_")
    full = pairs.join(to, ["lang", "a", "base_b"], "left").join(from_, ["lang", "b", "base_a"], "left").join(_both(terms, groups), ["lang", "a", "b"], "left")
    none = (F.col("v") - F.col("own_a") - F.col("own_b")) * excess(F.col("base_a"), F.col("base_b"))
    value = F.coalesce(none, F.lit(0)) + sum((F.coalesce(c, F.lit(0)) for c in ("to", "from_", "fix")), F.lit(0))
    out = full.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.cast("bigint").alias("value"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    terms, groups = shares(docs, term_counts(docs, text, lang, source), least, lang, source)
    part = lambda name, df: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part("term", over_used(terms, ranks)).unionByName(part("pair", divergence(terms, groups)))


def op11_radix_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3
), sized AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*) AS v FROM kept GROUP BY lang
), gr AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT gr.lang, gr.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM gr LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + s.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v) AS q
  FROM g JOIN sized s USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sums.value, 0)::BIGINT AS value
  FROM gr x JOIN gr y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums ON sums.lang = x.lang AND sums.source = x.source AND sums.item = y.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

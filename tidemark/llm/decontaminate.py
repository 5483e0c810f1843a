"""Benchmark decontamination with suffix arrays of the training text.

Each task holds a shard of documents as one sequence of word numbers over the benchmark's vocabulary
(other words and document ends are terminators), sorts the shard's suffixes as deep as the longest
item, and finds every suffix of every item by binary search: its longest verbatim match is with a
neighbour of its place.  Where that match has ``window`` words or more, two more searches give the range
of positions that share the window, once for all suffixes that begin with it; the words there are hit.  A
position's own longest match is again with a neighbour of its place, in the suffix array of the items, so
that every document gets its longest match.  Nothing is made for pairs of positions and suffixes: items that
share a header cost their documents one list of texts, which documents with the same windows share.

The benchmark goes to executors in blocks of ``BLOCK_BYTES`` of text, each read, broadcast and
searched for itself, one pass after the other; what a pass found travels with its row.  Documents
are never shuffled, so repeated, frequent or long texts change nothing but their own shard.

Rows: a null or empty text has no words and is never contaminated; items without words are ignored;
an item without id marks words but is neither counted nor named; repeated items count once for each
id; repeated documents are judged alike.  An empty benchmark leaves everything clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

WINDOW = 13
#: Names in a batch of results.
NAMES = 1 << 19
#: Text of a benchmark block, and of documents in a shard.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 6 << 20
TABLE = C.byte_table(1, lower=True)


def word_hashes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and offsets by document."""
    starts, ends, at = C.spans(data, places, C.ALNUM)
    return C.hashes(data, starts, ends, TABLE)[0], at


class Items:
    """Items as word numbers: vocabulary, the distinct texts one after the other, and who owns each."""

    def __init__(self, rows: list[tuple], window: int):
        texts = [str(t or "").encode() for _, t in rows]
        words, at = word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        self.vocabulary = np.unique(words)
        number = (np.searchsorted(self.vocabulary, words) + 1).astype(np.int32)
        owners: dict[bytes, set] = {}
        for i, (item, _) in enumerate(rows):
            if at[i + 1] > at[i]:
                owners.setdefault(number[at[i] : at[i + 1]].tobytes(), set()).update([] if item is None else [str(item)])
        self.names = [sorted(x) for x in owners.values()]
        self.texts = [np.frombuffer(k, np.int32) for k in owners]
        self.size = window
        self.longest = max((len(t) for t in self.texts), default=0)
        self.words = np.concatenate([x for t in self.texts for x in (t, np.zeros(1, np.int32))] or [np.zeros(0, np.int32)])
        start = np.cumsum([0, *[len(t) + 1 for t in self.texts]]).astype(np.int64)
        #: Every suffix: its start, its length, the text it belongs to, and whether a whole window begins there.
        self.suffix = np.concatenate([start[i] + np.arange(len(t)) for i, t in enumerate(self.texts)] or [np.zeros(0, np.int64)])
        self.length = np.concatenate([len(t) - np.arange(len(t)) for t in self.texts] or [np.zeros(0, np.int64)])
        self.text = np.repeat(np.arange(len(self.texts)), [len(t) for t in self.texts])
        self.place = self.suffix - start[self.text] if len(self.text) else self.suffix
        size = np.array([min(window, len(t)) for t in self.texts], np.int64)[self.text] if len(self.text) else self.suffix
        self.window = np.where(self.length >= size, size, 0)
        #: Place of each text in the order of its least id; texts without id come last.
        self.rank = np.argsort(sorted(range(len(self.names)), key=lambda t: (not self.names[t], self.names[t][:1])))
        self.by_rank = np.argsort(self.rank)
        #: Suffixes in order, and what they are chosen by among equals.
        self.array = suffix_array(self.words, max(1, self.longest))
        suffix_at = np.zeros(len(self.words) + 1, np.int64)
        suffix_at[self.suffix] = np.arange(len(self.suffix))
        own = suffix_at[self.array]
        self.choice = np.stack([self.rank[self.text[own]], self.place[own]], axis=1) if len(own) else np.zeros((0, 2), np.int64)
        self._group(own)

    def _group(self, own: np.ndarray) -> None:
        """Suffixes by the window they begin with: ``group`` of each (-1: none), a ``lead`` for each group, and the class of
        texts that have it; ``texts_of`` lists a class's texts, which groups with the same texts share."""
        self.group = np.full(len(self.suffix), -1)
        own = own[self.window[own] > 0]
        same = np.zeros(len(own), bool)
        if len(own) > 1:
            a, b = own[:-1], own[1:]
            same[1:] = (self.window[a] == self.window[b]) & (common_length(self.words, self.suffix[a], self.words, self.suffix[b], self.window[a]) >= self.window[a])
        self.group[own] = np.cumsum(~same) - 1
        self.lead = own[~same]
        pairs = np.unique(np.stack([self.group[own], self.text[own]]), axis=1)
        edges = np.searchsorted(pairs[0], np.arange(len(self.lead) + 1))
        classes: dict[bytes, int] = {}
        self.owners = np.array([classes.setdefault(pairs[1, a:b].tobytes(), len(classes)) for a, b in zip(edges, edges[1:])], np.int64)
        self.texts_of = [np.frombuffer(k, np.int64) for k in classes]

    def names_of(self, owners: list[int]) -> list[str]:
        """Ids, in order, of the items whose texts are in any of the classes."""
        mark = np.zeros(len(self.texts), bool)
        for k in owners:
            mark[self.texts_of[k]] = True
        return sorted({n for t in np.flatnonzero(mark) for n in self.names[t]})


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first ``depth`` words; word 0 ends a suffix and starts none.

    Prefix doubling over the groups that are still open: more than one member, and no end reached."""
    at = np.flatnonzero(words)
    if not len(at):
        return at
    n = len(words)
    ends = np.append(np.flatnonzero(words == 0), n)
    left = ends[np.searchsorted(ends, at)] - at  # words before the end
    order = np.argsort(words[at], kind="stable")
    at, left = at[order], left[order]
    key = words[at].astype(np.int64)
    rank = np.zeros(n + 1, np.int64)
    head = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, np.arange(len(at)), 0))
    rank[at] = head + 1
    size, slots = 1, np.arange(len(at))
    while size < depth:
        own = at[slots]
        head = rank[own]
        alone = np.bincount(head, minlength=1)[head] == 1
        slots = slots[~alone & (left[slots] >= size)]
        if not len(slots):
            break
        own = at[slots]
        key = rank[own] << 32 | rank[np.minimum(own + size, n)]
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        # slots of a group are consecutive among the open ones, so sorting by (group, next) keeps groups in place
        at[slots], left[slots] = own, left[slots][order]
        new = np.diff(key, prepend=-1) != 0
        first = np.flatnonzero(new)
        shift = np.arange(len(key)) - first[np.cumsum(new) - 1]
        rank[own] = slots - shift + 1
        size *= 2
    return at


def search(words: np.ndarray, array: np.ndarray, sought: np.ndarray, start: np.ndarray, depth: np.ndarray, upper: bool = False) -> np.ndarray:
    """Binary search of many patterns at once: first place in ``array`` whose suffix is not below
    ``sought[start : start + depth]`` (with ``upper``: whose first ``depth`` words are above it)."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    n, most = len(words), len(sought) - 1
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        p, s, d = array[mid], start[open_], depth[open_]
        below = np.full(len(open_), upper)
        active, k = np.arange(len(open_)), 0
        while len(active):
            active = active[k < d[active]]
            at = p[active] + k
            a = np.where(at < n, words[np.minimum(at, n - 1)], 0)
            b = sought[np.minimum(s[active] + k, most)]
            below[active[a < b]] = True
            below[active[a > b]] = False
            active = active[a == b]
            k += 1
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]


def common_length(words: np.ndarray, at: np.ndarray, sought: np.ndarray, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    k, n = 0, len(words)
    while len(active):
        active = active[k < depth[active]]
        p = at[active] + k
        same = np.where(p < n, words[np.minimum(p, n - 1)], -1) == sought[start[active] + k]
        active = active[same]
        out[active] += 1
        k += 1
    return out


class Shard:
    """A shard's words, numbered by an item block's vocabulary, and its suffix array."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, items: Items):
        place = np.searchsorted(items.vocabulary, hashes)
        known = items.vocabulary[np.minimum(place, len(items.vocabulary) - 1)] == hashes if len(items.vocabulary) else np.zeros(len(hashes), bool)
        docs = len(at) - 1
        self.first = at + np.arange(docs + 1)  # where each document begins, one end after each
        self.words = np.zeros(len(hashes) + docs, np.int32)
        shift = np.repeat(np.arange(docs), np.diff(at))
        self.words[np.arange(len(hashes)) + shift] = np.where(known, place + 1, 0)
        self.array = suffix_array(self.words, max(1, items.longest))

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def occurrences(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """(position, group) for every place where a whole window of an item occurs: of suffixes whose longest match is that long."""
        own = np.flatnonzero((items.window > 0) & (self.longest(items)[0] >= items.window))
        groups = np.unique(items.group[own])
        lead = items.lead[groups]
        lo, hi = (search(self.words, self.array, items.words, items.suffix[lead], items.window[lead], upper) for upper in (False, True))
        each = hi - lo
        at = np.repeat(lo, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        return self.array[at], np.repeat(groups, each)

    def reach(self, items: Items, position: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Words of the longest match at each position with the suffixes of its group, which are neighbours in the items' order."""
        size = items.window[items.lead[group]]
        depth = np.minimum(self.left(position), items.longest)
        at, best = search(items.words, items.array, self.words, position, depth), np.zeros(len(position), np.int64)
        for near in (at - 1, at):
            ok = (near >= 0) & (near < len(items.array))
            best = np.maximum(best, np.where(ok, common_length(items.words, items.array[np.clip(near, 0, len(items.array) - 1)], self.words, position, depth), 0))
        return np.where(size == items.size, best, size)  # a shorter window is a whole item

    def left(self, position: np.ndarray) -> np.ndarray:
        """Known words from each position to the next unknown one or the document's end."""
        ends = np.flatnonzero(self.words == 0)
        return ends[np.searchsorted(ends, position)] - position

    def longest_of_documents(self, items: Items, position: np.ndarray, group: np.ndarray) -> dict[int, tuple]:
        """By document: words, first word, item and place in it of its longest match; of equals the first, then the least item."""
        if not len(position):
            return {}
        far, doc = self.reach(items, position, group), self.doc(position)
        order = np.lexsort((position, -far, doc))
        top = order[np.diff(doc[order], prepend=-1) != 0]
        position, far, doc, group = position[top], far[top], doc[top], group[top]
        lo, hi = (search(items.words, items.array, self.words, position, far, upper) for upper in (False, True))
        chosen: dict[tuple, tuple] = {}
        out = {}
        for d, p, f, a, b, g in zip(doc.tolist(), position.tolist(), far.tolist(), lo.tolist(), hi.tolist(), group.tolist()):
            if f < items.size:  # a whole short item
                i = items.lead[g]
                text, place = items.text[i], items.place[i]
            else:
                if (a, b) not in chosen:
                    own = items.choice[a:b]
                    chosen[a, b] = tuple(own[np.lexsort((own[:, 1], own[:, 0]))[0]].tolist())
                rank, place = chosen[a, b]
                text = items.by_rank[rank]
            out[d] = (f, p - int(self.first[d]), next(iter(items.names[text]), None), int(place))
        return out

    def longest(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix of every item: its longest match in the shard, and where (-1: none)."""
        if not len(self.array) or not len(items.suffix):
            return np.zeros(len(items.suffix), np.int64), np.full(len(items.suffix), -1)
        at = search(self.words, self.array, items.words, items.suffix, items.length)
        best, where = np.zeros(len(at), np.int64), np.full(len(at), -1)
        for near in (at - 1, at):
            ok = (near >= 0) & (near < len(self.array))
            p = self.array[np.clip(near, 0, len(self.array) - 1)]
            n = np.where(ok, common_length(self.words, p, items.words, items.suffix, items.length), 0)
            where, best = np.where(n > best, p, where), np.maximum(n, best)
        return best, where


def blocks(benchmark: DataFrame, item: str, text: str, window: int):
    """The benchmark as ``Items``, in blocks of bounded text (a block is read only when asked for)."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield Items([tuple(r) for r in own.collect()], window)


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.StructType([T.StructField("length", T.LongType()), T.StructField("word", T.LongType()), T.StructField("item", T.StringType()), T.StructField("place", T.LongType())])),
])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct appended (last column): n_words, hit word ranges, the items found, and the longest verbatim
    match of a window or more (its words, where it begins in the document, the item, and where in it; ties go to the first
    word, then the least item; null: none)."""
    sc = docs.sparkSession.sparkContext
    raw, name = C.fresh("raw_text", docs.columns), C.fresh(out, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(raw, T.BinaryType()), T.StructField(name, FOUND)])
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.struct([("length", pa.int64()), ("word", pa.int64()), ("item", pa.string()), ("place", pa.int64())]))])
    found = docs.withColumn(raw, C.text_of(text)).withColumn(name, F.lit(None).cast(FOUND))

    def one(shared):
        def work(batches):
            items = shared.value
            for batch in C.gather(batches, raw, SHARD_BYTES):
                hashes, at = word_hashes(*C.flat(batch.column(raw)))
                shard = Shard(hashes, at, items)
                position, group = shard.occurrences(items)
                edge = np.zeros(len(shard.words) + 1, np.int64)
                np.add.at(edge, position, 1)
                np.add.at(edge, position + items.window[items.lead[group]], -1)
                hit = np.append(np.cumsum(edge[:-1]) > 0, False)
                ends = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
                starts, stops = ends[::2], ends[1::2]
                of = shard.doc(starts)
                longest = shard.longest_of_documents(items, position, group)
                ranges: dict[int, list] = {}
                for d, a, b in zip(of.tolist(), starts.tolist(), stops.tolist(), strict=True):
                    ranges.setdefault(d, []).append((a - int(shard.first[d]), b - int(shard.first[d])))
                classes: dict[int, list] = {}
                for d, k in np.unique(np.stack([shard.doc(position), items.owners[group]]), axis=1).T.tolist():
                    classes.setdefault(d, []).append(k)
                lists: dict[tuple, list] = {}  # documents with the same windows share a list of names
                rows, first, many = [], 0, 0
                for d in range(len(batch)):
                    old = batch.column(name)[d].as_py()
                    own, kinds, most = ranges.get(d, []), tuple(classes.get(d, ())), longest.get(d)
                    if kinds not in lists:
                        lists[kinds] = items.names_of(list(kinds))
                    who = lists[kinds]
                    if old:
                        own = merged([(x["start"], x["end"]) for x in old["hits"]] + own)
                        who = sorted({*who, *old["items"]}) if who and old["items"] else who or old["items"]
                        most = longer(most, old["longest"] and tuple(old["longest"].values()))
                    rows.append({"n_words": int(at[d + 1] - at[d]), "hits": [{"start": a, "end": b} for a, b in own], "items": who, "longest": most and dict(zip(("length", "word", "item", "place"), most, strict=True))})
                    many += len(who)
                    if many >= NAMES or d == len(batch) - 1:
                        part = batch.slice(first, len(rows))
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, kind)], names=batch.schema.names)
                        rows, first, many = [], d + 1, 0

        return work

    none = True
    for items in blocks(benchmark, item, item_text, window):
        found, none = C.mapped(found, one(sc.broadcast(items)), schema), False
    if none:
        found = C.mapped(found, one(sc.broadcast(Items([], window))), schema)
    return found.drop(raw)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def longer(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two matches (length, word, item, place) the longer, then the earlier, then that of the lesser item."""
    return min((x for x in (a, b) if x), key=lambda x: (-x[0], x[1], x[2] is None, x[2] or "", x[3]), default=None)


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = WINDOW) -> DataFrame:
    """(item_text, place, length, doc, word): for each suffix of each distinct item text (as its list of
    item ids), the longest verbatim match of ``least`` words or more over all shards, and where it is.
    A shard names one of its longest matches; between shards, ties go to the smallest document key, then the first word."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), C.text_of(text).alias("raw"))
    all_found = None
    for items in blocks(benchmark, item, item_text, least):
        shared = sc.broadcast(items)

        def work(batches, shared=shared):
            items = shared.value
            for batch in C.gather(batches, "raw", SHARD_BYTES):
                shard = Shard(*word_hashes(*C.flat(batch.column("raw"))), items)
                best, where = shard.longest(items)
                own = np.flatnonzero(best >= least)
                doc = shard.doc(where[own])
                yield pa.RecordBatch.from_arrays([
                    pa.array([items.names[t] for t in items.text[own]], pa.list_(pa.string())), pa.array(items.place[own]), pa.array(best[own]),
                    batch.column("doc").take(pa.array(doc)), pa.array(where[own] - shard.first[doc]),
                ], names=["items", "place", "length", "doc", "word"])

        found = C.mapped(rows, work, f"items array<string>, place bigint, length bigint, doc {kind}, word bigint")
        all_found = found if all_found is None else all_found.unionByName(found)
    if all_found is None:
        return docs.sparkSession.createDataFrame([], f"items array<string>, place bigint, length bigint, doc {kind}, word bigint")
    best = F.min(F.struct((-F.col("length")).alias("less"), "doc", "word"))
    return all_found.groupBy("items", "place").agg(best.alias("b")).select("items", "place", (-F.col("b.less")).alias("length"), "b.doc", "b.word")


def hit_words(name: str):
    return F.aggregate(F.col(f"{name}.hits"), F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])


def contaminated(name: str):
    """A twentieth of the words or more, and at least one, lie in benchmark windows."""
    return (hit_words(name) > 0) & (hit_words(name) * 20 >= F.col(f"{name}.n_words"))


def op1_suffix_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, then the words of each document's longest verbatim match (0: none) and the word it begins at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", F.col("contamination.n_words"), hit_words("contamination").alias("n_hit"), F.size("contamination.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "contamination.items"), 256).alias("items_sha256"), contaminated("contamination").alias("contaminated"),
        F.coalesce("contamination.longest.length", F.lit(0).cast("bigint")).alias("longest_match"), F.col("contamination.longest.word").alias("longest_at"),
    )


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~contaminated(found.columns[-1])).select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, ws, least(13, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT i, item_id, k, ji, array_to_string(ws[ji : ji + k - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS ji FROM i)),
dw AS (SELECT rid, k, j, array_to_string(ws[j : j + k - 1], ' ') AS w FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM iw))),
m AS (SELECT rid, j, k, i, ji, item_id FROM dw JOIN iw USING (k, w)),
run AS (SELECT rid, k, j, j - row_number() OVER (PARTITION BY rid, i, j - ji ORDER BY j) AS part, i, j - ji AS diagonal FROM m),
far AS (SELECT rid, min(j) - 1 AS word, count(*) + k - 1 AS length FROM run GROUP BY rid, i, diagonal, part, k),
lm AS (SELECT rid, max(length) AS length, arg_min(word, (-length, word)) AS word FROM far GROUP BY rid),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(j, j + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated, coalesce(lm.length, 0)::BIGINT AS longest_match, lm.word::BIGINT AS longest_at
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN lm USING (rid)
"""

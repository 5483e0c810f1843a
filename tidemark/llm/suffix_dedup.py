"""Removal of long repeated byte strings by column-wise multi-document suffix sorting.

A plain column-wise construction (one symbol of every document a round) takes as many rounds over the
whole collection as the longest document has bytes.  Here it runs over small aligned collections:

1. Every window of ``least`` bytes has an anchor, the 32-byte gram of least hash in it (the leftmost of
   equal ones), at some distance from its start.  Windows whose distances lie in one span of ``SPAN`` have
   bytes in common, all of one place: their core.  Equal windows have equal anchors at equal distances,
   so equal cores, and a window can only equal windows of its core.  Consecutive windows with one
   core form a stretch; a text's stretches are found with sliding minima, and equal texts are merged first.
   Stretches of one text with the same bytes (a text that repeats a short string has one at every byte)
   are settled at once, and one of them stands for all.
2. Cores of a single stretch are dropped.  The bytes of the other stretches go to their core's task, by
   Spark's sorted shuffle files.
3. There, with the cores aligned, the columns are inserted from right to left, one symbol of each
   stretch a round: a stable sort by symbol of the order so far gives the order of all suffixes that
   begin at the column, and the common prefixes of neighbours follow from the previous ones.  A window
   is repeated where its suffix shares ``length`` bytes or more with a neighbour; with ``least`` bytes or
   more it belongs to a shorter passage, which is reported beside.
4. Cores with more than ``HOT`` stretches (a passage that very many documents hold) would fill a task.
   Their windows are hashed to 96 bits instead and meet by hash, those that repeat in a task being settled
   there first.

Rows: null and empty texts keep nothing and lose nothing.  Repeated rows and equal texts repeat each
other: all of their windows go, in each copy.  Texts shorter than ``length`` are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

LENGTH = 400
#: Shorter passages that are reported beside: bytes that their search starts from, and words that they hold.
LEAST = 240
PASSAGE_WORDS = 50
GRAM = 32
#: Window starts that share a core, and the size of the grams that it is hashed by.
SPAN, PART = 128, 64
HOT = 1000
CHUNK = 2 << 20
PLACE_BITS = np.uint64(24)
TABLE = C.byte_table(10)
STRETCH = T.ArrayType(T.StructType([T.StructField("anchor", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("first", "last", "place"))]))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` (a power of two) bytes from each place on, by doubling."""
    out, step, weight = TABLE[data], 1, int(C.POWER)
    with np.errstate(over="ignore"):
        while step < size and len(out) > step:
            out = out[:-step] + out[step:] * np.uint64(weight)
            weight = weight * weight & C.MASK
            step *= 2
    return C.mix(out) if step == size else np.zeros(0, np.uint64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, step = values, 1
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def stretches(data: np.ndarray, places: np.ndarray, least: int, length: int):
    """Document, core, first and last window start and anchor place (within the document) of each stretch, and a hash of its bytes."""
    none = tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < least:
        return none
    grams = gram_hashes(data, GRAM)
    order = grams >> PLACE_BITS << PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
    lowest = (sliding_min(order, least - GRAM + 1) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    starts = np.arange(len(lowest))
    doc = np.repeat(np.arange(len(places) - 1), np.diff(places))[: len(starts)]
    ok = starts + least <= places[doc + 1]
    starts, lowest, doc = starts[ok], lowest[ok], doc[ok]
    if not len(starts):
        return none
    span = (lowest - starts) // SPAN
    new = np.ones(len(starts), bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | (doc[1:] != doc[:-1]) | (span[1:] != span[:-1])
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    d, place, span = doc[at], lowest[at], span[at]
    parts = gram_hashes(data, PART)
    size = least - SPAN + 1
    end = np.minimum(last + length, places[d + 1])
    with np.errstate(over="ignore"):
        core, body = span.astype(np.uint64), (end - first).astype(np.uint64)
        for k in range(0, size, PART):
            core = C.mix(core + parts[place - SPAN * span + min(k, size - PART)])
        for k in range(0, SPAN + length, PART):
            body = C.mix(body + parts[np.minimum(first + k, end - PART)])
    return d, core, first - places[d], last - places[d], place - places[d], body


def find_stretches(texts: DataFrame, least: int, length: int) -> DataFrame:
    """(h1, h2, n, found, settled) for each row of ``texts`` (h1, h2, raw): its size, stretches, and ranges known to repeat."""

    def work(batches):
        for batch in batches:
            for piece in C.pieces(batch, "raw", CHUNK):
                data, places = C.flat(piece.column("raw"))
                if len(data) < 1 << int(PLACE_BITS):
                    parts = [stretches(data, places, least, length)]
                else:  # one very long text: overlapping parts; a stretch that a cut divides stays divided
                    step, parts = 1 << 22, []
                    for at in range(0, max(1, len(data) - least + 1), step):
                        own = data[at : at + step + length - 1]
                        d, core, a, b, p, body = stretches(own, np.array([0, len(own)]), least, length)
                        ok = a < step  # windows of the next part are found there
                        parts.append((d[ok], core[ok], a[ok] + at, np.minimum(b[ok], step - 1) + at, p[ok] + at, body[ok]))
                doc, core, first, last, place, body = (np.concatenate(x) for x in zip(*parts, strict=True))
                with np.errstate(over="ignore"):
                    same = C.mix(C.mix(body + core) + (place - first).astype(np.uint64) + C.mix(doc.astype(np.uint64) + (last - first).astype(np.uint64) * np.uint64(1 << 32)))
                order = np.argsort(same, kind="stable")
                new = np.append(True, same[order[1:]] != same[order[:-1]]) if len(order) else np.zeros(0, bool)
                lead = np.zeros(len(order), bool)
                lead[order[new]] = True
                many = np.zeros(len(order), bool)
                if len(order):
                    many[order] = (np.diff(np.append(np.flatnonzero(new), len(order))) > 1)[np.cumsum(new) - 1]
                row, start, end = merged(np.arange(len(piece)), doc[many], first[many], last[many] + length)
                struct = pa.StructArray.from_arrays([pa.array(core[lead].view(np.int64)), *(pa.array(x[lead].astype(np.int32)) for x in (first, last, place))], ["anchor", "first", "last", "place"])
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[lead], np.arange(len(piece) + 1)).astype(np.int32)), struct)
                ranges = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start, end)], ["start", "end"])
                settled = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(piece) + 1)).astype(np.int32)), ranges)
                yield pa.RecordBatch.from_arrays([piece.column("h1"), piece.column("h2"), pa.array(np.diff(places)), found, settled], names=["h1", "h2", "n", "found", "settled"])

    ranges = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end")]))
    return C.mapped(texts, work, T.StructType([*(T.StructField(n, T.LongType()) for n in ("h1", "h2", "n")), T.StructField("found", STRETCH), T.StructField("settled", ranges)]))


def repeated_windows(group: np.ndarray, data: np.ndarray, places: np.ndarray, left: np.ndarray, length: int, least: int = 0) -> np.ndarray:
    """For stretches in order of their group: [stretch, window], 1 where the window occurs twice in the group;
    with ``least``, 1 where its first ``least`` bytes do and 2 where all do.

    Column c holds the bytes c places right of the anchors.  ``order`` sorts the suffixes that begin at
    the last column within each group, ``shared`` holds the common prefix with the suffix before."""
    n = len(group)
    size = np.diff(places)
    base, right = places[:-1] + left, size - left
    found = np.zeros((n, int(size.max()) - (least or length) + 1), np.int8)
    order, shared = np.arange(n), np.zeros(n + 1, np.int32)
    number = np.cumsum(np.diff(group, prepend=group[:1]) != 0) * 512
    for column in range(int(right.max()) - 1, -int(left.max()) - 1, -1):
        inside = (column < right[order]) & (column >= -left[order])
        symbol = np.where(inside, data[np.where(inside, base[order] + column, 0)].astype(np.int64), 256)
        key = number[order] + symbol
        if (key[1:] >= key[:-1]).all():
            index, same = np.arange(n), key[1:] == key[:-1]
        else:
            index = np.argsort(key, kind="stable")
            key = key[index]
            same = key[1:] == key[:-1]
        same &= (key[1:] & 511) < 256
        new = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(same) + 1
        if len(at):
            a, b = index[at - 1] + 1, index[at]
            low = shared[b]
            far = np.flatnonzero(a < b)
            if len(far):
                pairs = np.stack([a[far], b[far] + 1], axis=1).ravel()
                low[far] = np.minimum.reduceat(shared, pairs)[::2]
            new[at] = np.minimum(low + 1, length)
        order, shared = order[index], new
        most = np.maximum(shared[:-1], shared[1:])
        twice = most >= (least or length)
        if twice.any():
            own = order[twice]
            found[own, column + left[own]] = 1 + ((most[twice] >= length) & (least > 0))
    return found


def ranges_of(found: np.ndarray, first: np.ndarray, length: int):
    """(stretch, start, end) of the byte ranges that runs of repeated windows cover."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1]
    return row, first[row] + a, first[row] + b - 1 + length


RANGES = "h1 bigint, h2 bigint, start int, end int, long boolean"


def _ranges(batch, row, start, end, long):
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([batch.column("h1").take(at), batch.column("h2").take(at), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.full(len(row), long))], names=["h1", "h2", "start", "end", "long"])


def by_columns(rows: DataFrame, length: int, least: int) -> DataFrame:
    """Ranges of repeated windows, from stretches (anchor, h1, h2, first, last, place, raw) of cores that fit a task."""

    def solve(batch):
        order = np.argsort(batch.column("anchor").to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        data, places = C.flat(batch.column("raw"))
        first = batch.column("first").to_numpy().astype(np.int64)
        found = repeated_windows(batch.column("anchor").to_numpy(), data, places, batch.column("place").to_numpy() - first, length, least)
        # the bytes after a stretch's last window start belong to other stretches
        found[np.arange(found.shape[1]) > (batch.column("last").to_numpy() - first)[:, None]] = 0
        yield _ranges(batch, *ranges_of(found > 0, first, least), False)
        yield _ranges(batch, *ranges_of(found > 1, first, length), True)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(C.flat(batch.column("raw"))[0])
            if size >= CHUNK:
                whole = pa.concat_batches(held)
                last = whole.column("anchor")[len(whole) - 1].as_py()
                cut = int(np.searchsorted(whole.column("anchor").to_numpy(), last))  # the last anchor may go on
                for a, b in _parts(whole.column("anchor").to_numpy()[:cut], C.flat(whole.column("raw"))[1]):
                    yield from solve(whole.slice(a, b - a))
                held, size = [whole.slice(cut)], len(C.flat(whole.slice(cut).column("raw"))[0])
        if held:
            whole = pa.concat_batches(held)
            for a, b in _parts(whole.column("anchor").to_numpy(), C.flat(whole.column("raw"))[1]):
                yield from solve(whole.slice(a, b - a))

    # sorted by anchor, a task's groups follow each other
    return C.mapped(rows.repartition("anchor").sortWithinPartitions("anchor"), work, RANGES)


def _parts(anchors: np.ndarray, places: np.ndarray):
    """Runs of whole groups with about CHUNK bytes."""
    edges = np.flatnonzero(np.diff(anchors)) + 1 if len(anchors) else np.zeros(0, np.int64)
    ends, at = np.append(edges, len(anchors)), 0
    while at < len(anchors):
        fit = ends[(ends > at) & (places[ends] - places[at] <= CHUNK)]
        to = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
        yield at, to
        at = to


def merged(text: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Ranges (row, start, end) with those joined that touch and lie in one text (by row); rows of the first stay."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, text[row]))
    row, start, end = row[order], start[order], end[order]
    base = text[row].astype(np.int64) << 40
    reach = np.maximum.accumulate(base + end)
    new = np.append(True, base[1:] + start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], (reach - base)[np.append(first[1:], len(row)) - 1]


WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u4"), ("text", "<u4"), ("start", "<i4"), ("many", "u1")])


def by_hashes(rows: DataFrame, length: int, least: int, tasks: int) -> DataFrame:
    """The same for anchors of many stretches: windows are hashed to 96 bits and meet by hash.

    What repeats among a task's own windows is settled there and goes on as ranges; of each hash one
    window goes on, packed, and only those that were alone in their task are answered."""
    long = length > least
    other = C.byte_table(11)
    back = pow(int(C.POWER), -1, 1 << 64)
    names = ["dest", "h1", "h2", "start", "end", "texts", "windows"]

    def work(batches):
        for piece in C.gather(batches, "raw", 1 << 19):
            data, places = C.flat(piece.column("raw"))
            windows = np.clip(np.diff(places) - length + 1, 0, piece.column("last").to_numpy() - piece.column("first").to_numpy() + 1)
            row = np.repeat(np.arange(len(piece)), windows)
            start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = places[row] + start
            with np.errstate(over="ignore"):
                weight = C.powers(len(data))
                undo = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data), back, np.uint64)]))
                w1, w2 = (C.mix((total[at + length] - total[at]) * undo[at]) for total in (np.concatenate([np.zeros(1, np.uint64), np.cumsum(t[data] * weight)]) for t in (TABLE, other)))
            order = np.lexsort((w2, w1))
            new = np.ones(len(order), bool)
            new[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
            lead = np.flatnonzero(new)
            count = np.diff(np.append(lead, len(order)))
            first = piece.column("first").to_numpy().astype(np.int64)
            twice = np.zeros((len(piece), int(windows.max(initial=1))), bool)
            again = order[np.repeat(count > 1, count)]
            twice[row[again], start[again]] = True
            r, a, b = ranges_of(twice, first, length)
            keys = np.stack([piece.column("h1").to_numpy(), piece.column("h2").to_numpy()], axis=1)
            r, a, b = merged(np.cumsum(np.append(False, (keys[1:] != keys[:-1]).any(axis=1))), r, a, b)
            own, none = pa.array(r), pa.nulls(len(r), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(r % tasks, pa.int32()), piece.column("h1").take(own), piece.column("h2").take(own), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), none, none], names=names)
            one = order[lead]
            packed = np.empty(len(one), WINDOW)
            packed["w1"], packed["w2"], packed["text"], packed["start"], packed["many"] = w1[one], w2[one] >> np.uint64(32), row[one], first[row[one]] + start[one], count > 1
            dest = (w1[one] % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            edges = np.flatnonzero(np.diff(dest[order], prepend=-1))
            out = []
            for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                part = packed[order[x:y]]
                used, part["text"] = np.unique(part["text"], return_inverse=True)
                out.append((int(dest[order[x]]), keys[used].astype("<i8").tobytes(), part.tobytes()))
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), none, none, none.cast(pa.int32()), none.cast(pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=names)

    def solve(held):
        keys = [np.frombuffer(t, "<i8").reshape(-1, 2) for t, _ in held]
        parts = [np.frombuffer(w, WINDOW).copy() for _, w in held]
        base = 0
        for k, p in zip(keys, parts, strict=True):
            p["text"] += base
            base += len(k)
        keys, whole = np.concatenate(keys), np.concatenate(parts)
        whole = whole[np.lexsort((whole["w2"], whole["w1"]))]
        same = (whole["w1"][1:] == whole["w1"][:-1]) & (whole["w2"][1:] == whole["w2"][:-1])
        again = np.zeros(len(whole), bool)
        again[1:] |= same
        again[:-1] |= same
        asked = whole[again & (whole["many"] == 0)]
        asked = asked[np.lexsort((asked["start"], asked["text"]))]
        if not len(asked):
            return
        # neighbours of one text go on as one range
        new = np.ones(len(asked), bool)
        new[1:] = (asked["text"][1:] != asked["text"][:-1]) | (asked["start"][1:] > asked["start"][:-1] + length)
        first = np.flatnonzero(new)
        end = asked["start"][np.append(first[1:], len(asked)) - 1] + length
        own = keys[asked["text"][first]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[:, 0])), pa.array(np.ascontiguousarray(own[:, 1])), pa.array(asked["start"][first]), pa.array(end.astype(np.int32)), pa.array(np.full(len(first), long))], names=[*names[1:5], "long"])

    def meet(batches):
        held, at = [], None
        for batch in batches:
            settled = batch.column("windows").is_null()
            own = batch.filter(settled).select(names[1:5])
            yield C.with_column(own, "long", pa.array(np.full(len(own), long)))
            for dest, texts, windows in zip(*(batch.filter(pa.compute.invert(settled)).column(n).to_pylist() for n in ("dest", "texts", "windows")), strict=True):
                if held and dest != at:
                    yield from solve(held)
                    held = []
                at = dest
                held.append((texts, windows))
        if held:
            yield from solve(held)

    packed = C.mapped(rows, work, "dest int, h1 bigint, h2 bigint, start int, end int, texts binary, windows binary")
    return C.mapped(packed.repartition(tasks, "dest").sortWithinPartitions("dest"), meet, RANGES)


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT, least: int = LEAST) -> DataFrame:
    """(h1, h2, ranges, passages): for each different text the byte ranges that repeated windows of
    ``length``, and those of ``least`` bytes cover, merged and in order; texts with none are left out."""
    if not SPAN + PART <= least < length:
        raise ValueError(f"least must lie between {SPAN + PART} and length")
    raw = C.text_of(text)
    texts = docs.select(*text_key(text), raw.alias("raw")).where(F.octet_length("raw") >= least)
    # equal texts are merged map-side; each keeps its number of copies
    found = find_stretches(texts, least, length).groupBy("h1", "h2").agg(F.first("n").alias("bytes"), F.first("found").alias("found"), F.first("settled").alias("settled"), F.count("*").alias("copies"))
    found = C.materialise(found, "stretches")
    each = found.select("h1", "h2", F.inline("found"))
    # the counts are written first: the join then gets its rows as they are, and Spark splits hot cores
    shared = C.materialise(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "cores")
    wanted = C.materialise(each.join(shared, "anchor"), "wanted")
    by_text = wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("anchor", "first", "last", "place", "n")).alias("wanted"))
    joined = texts.join(by_text, ["h1", "h2"])

    def cut(batches):
        before = None
        for batch in batches:
            data, places = C.flat(batch.column("raw"))
            keys = np.stack([batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], axis=1)
            lists = batch.column("wanted")
            anchors, firsts, lasts, at, n = lists.flatten().flatten()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for i in range(len(batch)):
                key = (int(keys[i, 0]), int(keys[i, 1]))
                if key == before:  # copies come together; one is enough
                    continue
                before = key
                to = int(ends[i])
                a = int(ends[i - 1]) if i else 0
                body = data[places[i] : places[i + 1]]
                parts = [body[x : y + length].tobytes() for x, y in zip(firsts[a:to].to_pylist(), lasts[a:to].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchors[a:to], pa.array([key[0]] * len(parts), pa.int64()), pa.array([key[1]] * len(parts), pa.int64()), firsts[a:to], lasts[a:to], at[a:to], n[a:to], pa.array(parts, pa.binary())], names=["anchor", "h1", "h2", "first", "last", "place", "n", "raw"])

    rows = C.materialise(C.mapped(joined, cut, "anchor bigint, h1 bigint, h2 bigint, first int, last int, place int, n bigint, raw binary"), "anchored")
    ranges = by_columns(rows.where(F.col("n") <= hot).drop("n"), length, least)
    crowd = rows.where(F.col("n") > hot).select("h1", "h2", "first", "last", "raw")
    tasks = C.deal(texts, "raw")
    for size in (least, length):
        ranges = ranges.unionByName(by_hashes(crowd, size, least, tasks))
    for long, size in ((False, least), (True, length)):
        ranges = ranges.unionByName(found.where((F.col("copies") > 1) & (F.col("bytes") >= size)).select("h1", "h2", F.lit(0).alias("start"), F.col("bytes").cast("int").alias("end"), F.lit(long).alias("long")))
        ranges = ranges.unionByName(found.select("h1", "h2", F.inline("settled")).withColumn("long", F.lit(long)))

    def joined_up(which):
        return F.aggregate(
            F.array_sort(F.collect_list(F.when(F.col("long") == which, F.struct("start", "end")))), F.expr("cast(array() as array<struct<start:int,end:int>>)"),
            lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
        )

    return ranges.groupBy("h1", "h2").agg(joined_up(True).alias("ranges"), joined_up(False).alias("passages"))


def text_key(text: str):
    """128 bits that stand for a text."""
    raw = C.text_of(text)
    return F.xxhash64(raw).alias("h1"), F.xxhash64(raw, F.lit("text")).alias("h2")


def kept_bytes(raw, ranges):
    """What is left of binary ``raw`` without the ranges (null: all)."""
    gaps = F.aggregate(
        ranges, F.struct(F.lit(0).alias("at"), F.expr("cast('' as binary)").alias("kept")),
        lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["kept"], F.substring(raw, s["at"] + 1, x["start"] - s["at"])).alias("kept")),
    )
    return F.when(ranges.isNull(), raw).otherwise(F.concat(gaps["kept"], F.substring(raw, gaps["at"] + 1, F.octet_length(raw))))


NONE = "cast(array() as array<struct<start:int,end:int>>)"


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, least: int = LEAST, words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with the struct ``removed`` appended (last column): n_bytes, ranges (repeated strings of
    ``length`` bytes), kept (binary, what these leave), and passages (repeated strings of ``least`` bytes
    with ``words`` words or, whatever their words, ``length`` bytes)."""
    name, h1, h2, ranges, passages = (C.fresh(x, docs.columns) for x in ("removed", "h1", "h2", "ranges", "passages"))
    found = repeats(docs, text, length, least=least).select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("ranges").alias(ranges), F.col("passages").alias(passages))
    key = text_key(text)
    keyed = docs.withColumns({h1: key[0], h2: key[1]})
    raw = C.text_of(text)
    joined = keyed.join(found, [h1, h2], "left")
    enough = F.filter(passages, lambda x: (x["end"] - x["start"] >= length) | (F.regexp_count(F.substring(raw, x["start"] + 1, x["end"] - x["start"]).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")) >= words))
    return joined.select(*docs.columns, F.struct(F.octet_length(raw).cast("bigint").alias("n_bytes"), F.coalesce(ranges, F.expr(NONE)).alias("ranges"), kept_bytes(raw, F.col(ranges)).alias("kept"), F.coalesce(enough, F.expr(NONE)).alias("passages")).alias(name))


def op10_column_suffixes(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_passages: repeated passages of 50 words, also those under 400 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = F.aggregate("removed.ranges", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return remove(docs).select("doc_id", "removed.n_bytes", gone.alias("n_removed"), F.size("removed.ranges").cast("bigint").alias("n_spans"), F.sha2("removed.kept", 256).alias("kept_sha256"), F.size("removed.passages").cast("bigint").alias("n_passages"))


def suffix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages of 50 words or 400 bytes; a character that a cut divides
    becomes U+FFFD.  n_chars follows."""
    found = remove(docs)
    name = found.columns[-1]
    left = kept_bytes(C.text_of("text"), F.col(f"{name}.passages"))
    kept = F.when(F.size(f"{name}.passages") == 0, F.col("text")).otherwise(F.make_valid_utf8(left.cast("string")))
    found = found.withColumn("text", kept)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)

"""Near-duplicate passages through compact windows of token min-hashes.

For each of ``HASHES`` hash functions, the Cartesian tree over a document's shingle hashes groups all
runs of shingles by the place of their least hash: a node (first, place, last) stands for every run
that lies between first and last and holds the place.  Nodes too short for a passage are left out;
the rest are found from sliding minima, whose places are exactly the nodes that are long enough.

Functions are taken in pairs.  A run has a least place under both functions of a pair, and the two
shingles there are its key; both survive words that come or go beside them, so two runs with a Jaccard
similarity J share a pair's key with probability J * J, and one of ``HASHES / 2`` keys with 0.95 at 0.8;
a longer passage holds several such runs, and so more keys.

A window is joined with the least document of its key, and with the least ones of those whose shingles
after (before) the least one look the same.  Where these are no third document, it also meets
the document before it.  These are up to three pairs a window, however many documents share a passage, mostly with
the same documents under each key; and a document with a fragment of a passage does not stand between the others.  Leads are found among a
task's own rows first; only these and the last of each key travel.

What the leads leave out is made up for after they are verified.  A key of three documents or more is
settled if its documents are of one class and each has the key's place inside a passage.  The others
go to their least document (hub) as stretches of text, where those meet that are of different classes or have no passage there.  The pairs of one document pair are joined where their
intervals overlap and verified on the texts: passages of ``WORDS`` words or more with a Jaccard similarity
of 0.8 or more over five-word shingles.  Passages that a document repeats inside itself are not looked for.

Rows: null, empty and short texts have no passages.  Rows with one id are one document.  Repeated rows
and copies share their whole text; a null id is not compared and gets a row without passages.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .components import components

WORDS = 50
SHINGLE = 5
#: An even number of functions.
HASHES = 6
THRESHOLD = 80
CHUNK = 3 << 20
#: Shingles without a partner that a passage may hold in a row.
GAP = 8
TABLE = C.byte_table(30, lower=True)


def shingled(data: np.ndarray, places: np.ndarray):
    """Hashes of the five-word shingles of flat texts, and offsets by document (a text of n words has n - 4)."""
    starts, ends, at = C.spans(data, places, C.NOT_SPACE)
    words = C.hashes(data, starts, ends, TABLE)[0]
    run = C.in_runs(words, SHINGLE)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = doc[: len(run)] == doc[SHINGLE - 1 :][: len(run)]
    return run[ok], np.searchsorted(doc[: len(run)][ok], np.arange(len(at)))


def minima(values: np.ndarray, places: np.ndarray, width: int):
    """(document, place of the least value) of each run of ``width`` values inside a document, and the values' order."""
    bits = np.uint64(max(24, len(values).bit_length()))
    order = values >> bits << bits | np.arange(len(values), dtype=np.uint64)
    if len(values) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), order
    out, step = order, 1
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    out = np.minimum(out[: len(out) - (width - step)], out[width - step :])
    doc = np.repeat(np.arange(len(places) - 1), np.diff(places))[: len(out)]
    ok = np.arange(width, width + len(out)) <= places[doc + 1]
    return doc[ok], (out[ok] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), order


def compact_windows(values: np.ndarray, places: np.ndarray, width: int):
    """(document, first, place, last) of the nodes that span ``width`` values or more."""
    return nodes(*minima(values, places, width), places)


def nodes(doc, at, order, places):
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at, doc = at[new], doc[new]
    height = order[at]
    edge = np.append(True, doc[1:] != doc[:-1])
    before = lower(height, edge)
    after = len(at) - 1 - lower(height[::-1], np.append(edge[1:], True)[::-1])[::-1]
    first = np.where(before >= 0, at[before] + 1, places[doc])
    last = np.where(after < len(at), at[np.minimum(after, len(at) - 1)], places[doc + 1]) - 1
    return doc, first - places[doc], at - places[doc], last - places[doc]


def lower(height: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The nearest place before each whose height is less, -1 where its part (parts start at ``edge``) has none.

    What lies between a place and its pointer is higher, so a pointer to something higher moves on to that one's."""
    near = np.where(edge, -1, np.arange(len(height)) - 1)
    moving = np.flatnonzero(near >= 0)
    while len(moving):
        moving = moving[height[near[moving]] > height[moving]]
        near[moving] = near[near[moving]]
        moving = moving[near[moving] >= 0]
    return near


def paired_windows(one: np.ndarray, two: np.ndarray, places: np.ndarray, width: int):
    """(document, first, last, place under one, under two) of the runs that share both least places; places are absolute."""
    (doc, p, own), (_, q, other) = minima(one, places, width), minima(two, places, width)
    if not len(doc):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    x, y = nodes(doc, p, own, places), nodes(doc, q, other, places)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    doc, p, q = doc[new], p[new], q[new]
    # places rise with the runs, and each has one node
    i, j = np.searchsorted(x[2] + places[x[0]], p), np.searchsorted(y[2] + places[y[0]], q)
    return doc, np.maximum(x[1][i], y[1][j]), np.minimum(x[3][i], y[3][j]), p, q


#: Windows travel as one number: first and last shingle.
BITS = 28
LOW = (1 << BITS) - 1
#: What goes to a task: packed windows (the bytes of their numbers, place by place), the ids that they name, and pairs.
MEMBER = "dest int, ids binary, windows binary, pairs binary, crowds binary"
#: The pairs of windows of two documents, or (crowd) the windows of a document in a crowded key: a is the key, b the document, wb the place of the least shingle.
PAIR = "crowd boolean, a bigint, b bigint, w array<struct<wa: bigint, wb: bigint>>"
#: How far from the least shingle those are that say what lies after and before it.
NEAR = (1, 7, 14, 20)


def shared_keys(key: np.ndarray) -> np.ndarray:
    """Places of the keys that occur twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[1:] = same
    again[:-1] |= same
    return order[again]


def leads(key, sides, who) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row the row of the least document of its key, those of its key that look the same on either
    side, and, where these are no third document, the row before it in the order of documents; and the
    last row of each key."""
    base = np.argsort(who, kind="stable")
    base = base[np.argsort(key[base], kind="stable")]  # by key, then document
    k, out = key[base], []
    for side in (None, *sides):
        order = base if side is None else base[np.argsort((k << np.uint64(8)) | side[base], kind="stable")]
        own = key[order] if side is None else (key[order] << np.uint64(8)) | side[order]
        new = np.append(True, own[1:] != own[:-1])
        lead = np.empty(len(key), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        out.append(lead)
    before = np.arange(len(key))
    own = base[1:]
    alone = np.ones(len(own), bool)
    for side in out[1:]:
        alone &= (who[side[own]] == who[own]) | (who[side[own]] == who[out[0][own]])
    same = (k[1:] == k[:-1]) & alone
    before[base[1:][same]] = base[:-1][same]
    last = base[np.append(k[1:] != k[:-1], True)]
    return [*out, before], last


def neighbours(key, sides, who, w):
    """(a, b, w of a, w of b), a < b: each row with its leads; and which rows are a lead or the last of their key."""
    if not len(key):
        return np.zeros((4, 0), np.int64), np.zeros(0, bool)
    found, last = leads(key, sides, who)
    lead = np.zeros(len(key), bool)
    for x in (*found[:3], last):
        lead[x] = True
    row = np.tile(np.arange(len(key)), 4)
    to = np.concatenate(found)
    ok = who[to] != who[row]
    to, row = to[ok], row[ok]
    turn = who[to] > who[row]
    to, row = np.where(turn, row, to), np.where(turn, to, row)
    return np.stack([who[to], who[row], w[to], w[row]]), lead


def crowded(key, who, crowd, own) -> np.ndarray:
    """Those of the rows ``own`` whose key has three documents or more, or rows that stayed behind (``crowd``)."""
    own = own[np.lexsort((who[own], key[own]))]
    k, d = key[own], who[own]
    if not len(own):
        return own
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
    ok = (np.add.reduceat(new.astype(np.int64), first) > 2) | (np.maximum.reduceat(crowd[own], first) > 0)
    return own[np.repeat(ok, np.diff(np.append(first, len(own))))]


def listed(crowd: bool, table: np.ndarray) -> pa.RecordBatch:
    """A row (``PAIR``) for each a and b of a table of four rows: a, b, and what ``w`` lists, each once."""
    table = table[:, np.lexsort(table[::-1])]
    new = np.ones(table.shape[1], bool)
    new[1:] = (table[:, 1:] != table[:, :-1]).any(axis=0)
    table = table[:, new]
    first = np.ones(table.shape[1], bool)
    first[1:] = (table[:2, 1:] != table[:2, :-1]).any(axis=0)
    at = np.flatnonzero(first)
    w = pa.ListArray.from_arrays(pa.array(np.append(at, table.shape[1]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in table[2:]], names=["wa", "wb"]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), crowd)), pa.array(table[0, at]), pa.array(table[1, at]), w], names=["crowd", "a", "b", "w"])


def planes(*columns: np.ndarray) -> bytes:
    """The bytes of equally long arrays, place by place, so that what is mostly zero lies together; of the first, five."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1)[:, : None if k else 5].T).tobytes() for k, c in enumerate(columns))


def from_planes(body: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    table = np.frombuffer(body, np.uint8).reshape(sum(sizes) - 3, -1)
    table = np.concatenate([table[:5], np.zeros((3, table.shape[1]), np.uint8), table[5:]])
    ends = np.cumsum(sizes)
    return [np.ascontiguousarray(table[e - n : e].T).view(k).ravel() for e, n, k in zip(ends, sizes, kinds, strict=True)]


def meetings(rows: DataFrame, width: int, hashes: int, tasks: int) -> DataFrame:
    """The pairs of windows with a common key, of documents a < b, and the windows of crowded keys (``PAIR``)."""

    def index(batches):
        for batch in C.gather(batches, "raw", CHUNK):
            values, places = shingled(*C.flat(batch.column("raw")))
            ids = batch.column("id").to_numpy()
            seeds = C.seeds(hashes, 31)
            parts = []
            for f in range(0, hashes, 2):
                one, two = C.mix(values ^ seeds[f]), C.mix(values ^ seeds[f + 1])
                doc, first, last, p, q = paired_windows(one, two, places, width)
                if not len(doc):
                    continue
                begin, end = places[doc], places[doc + 1]
                with np.errstate(over="ignore"):
                    key = C.mix(one[p] + C.mix(two[q]) * np.uint64(3) + np.uint64(f)) >> np.uint64(8)
                    sides = []
                    for sign in (1, -1):
                        side = np.zeros(len(p), np.uint64)
                        for k in NEAR:
                            at = p + sign * k
                            side = C.mix(side + np.where((at >= begin) & (at < end), values[np.clip(at, 0, len(values) - 1)], np.uint64(0)))
                        sides.append((side >> np.uint64(56)).astype(np.uint8))
                parts.append((key, *sides, doc, first, last, p - begin))
            if not parts:
                continue
            key, after, before, doc, first, last, least = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = shared_keys(key)
            met, lead = neighbours(key[own], (after[own], before[own]), ids[doc[own]], ((first << BITS) | last)[own])
            met, travels = met.T, np.ones(len(key), bool)
            travels[own] = lead
            # what stays behind is a member of a crowded key; the rows of the key that travel tell the task that they meet in
            stays = np.flatnonzero(~travels)
            crowd = np.isin(key, key[stays]).astype(np.uint8)
            name = ((key >> np.uint64(16)) * np.uint64(tasks) + key % np.uint64(tasks)).view(np.int64)
            left = np.stack([name[stays], ids[doc[stays]], ((first << BITS) | last)[stays], least[stays]], axis=1)
            key, after, before, doc, first, last, least, crowd = (x[travels] for x in (key, after, before, doc, first, last, least, crowd))
            out: dict[int, list] = {}
            for column, at, rows in ((1, key % np.uint64(tasks), None), (3, (met[:, 0] ^ met[:, 1]) % tasks, met), (4, left[:, 1] % tasks, left)):
                order = np.argsort(at.astype(np.int64), kind="stable")
                at = at.astype(np.int64)[order]
                if not len(at):
                    continue
                edges = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
                for x, y in zip(edges, [*edges[1:], len(at)], strict=True):
                    own = order[x:y]
                    row = out.setdefault(int(at[x]), [b"", b"", b"", b""])
                    if column > 1:
                        row[column - 1] = rows[own].astype("<i8").tobytes()
                    else:
                        used, place = np.unique(doc[own], return_inverse=True)
                        row[0] = ids[used].astype("<i8").tobytes()
                        row[1] = planes((key[own] >> np.uint64(16)).astype("<u8"), after[own], before[own], crowd[own], (least - first)[own].astype("<u4"), place.astype("<u4"), first[own].astype("<u4"), (last - first)[own].astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), *(pa.array([v[k] for v in out.values()], pa.binary()) for k in range(4))], names=["dest", "ids", "windows", "pairs", "crowds"])

    def solve(held, dest):
        met = [np.frombuffer(x, "<i8").reshape(-1, 4).T for _, _, x, _ in held]
        many = [np.frombuffer(x, "<i8").reshape(-1, 4).T for *_, x in held]
        windows = [(np.frombuffer(i, "<i8"), *from_planes(x, "<u8", "u1", "u1", "u1", "<u4", "<u4", "<u4", "<u4")) for i, x, *_ in held if x]
        if windows:
            key, after, before, crowd, least, who, w = (np.concatenate(x) for x in zip(*((k, a, b, c, f.astype(np.int64) + p, i[d], (f.astype(np.int64) << BITS) | f + n.astype(np.int64)) for i, k, a, b, c, p, d, f, n in windows), strict=True))
            del windows
            own = shared_keys(key)
            met.append(neighbours(key[own], (after[own], before[own]), who[own], w[own])[0])
            own = np.concatenate([own, np.setdiff1d(np.flatnonzero(crowd), own)])
            own = crowded(key, who, crowd, own)
            many.append(np.stack([(key[own] * np.uint64(tasks) + np.uint64(dest)).view(np.int64), who[own], w[own], least[own]]))
        met, many = np.concatenate(met, axis=1), np.concatenate(many, axis=1)
        yield listed(False, met)
        yield listed(True, many)

    def meet(batches):
        held, at = [], None
        for batch in batches:
            for dest, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and dest != at:
                    yield from solve(held, at)
                    held = []
                at = dest
                held.append(own)
        if held:
            yield from solve(held, at)

    found = C.mapped(rows, index, MEMBER).repartition(tasks, "dest").sortWithinPartitions("dest")
    return C.mapped(found, meet, PAIR)


def passages_of(x: np.ndarray, y: np.ndarray, least: int, gap: int = GAP, threshold: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """Passages (first and end shingle in x, in y) of two runs of shingles that verify: stretches of
    common shingles with small gaps, where they are similar enough as wholes, else the parts on either side
    of their widest gap, and so on, and the runs of equal shingles inside what is left."""
    order = np.argsort(y, kind="stable")
    y_sorted = y[order]
    spot = np.searchsorted(y_sorted, x)
    found = y_sorted[np.minimum(spot, len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
    at = np.flatnonzero(found)
    if len(at) < least * threshold // (100 + threshold):
        return []
    to = order[spot[at]]
    x_sorted = np.sort(x)
    again = [np.unique(z[1:][z[1:] == z[:-1]]) for z in (x_sorted, y_sorted)]
    once = not len(again[0]) and not len(again[1])
    if not once:
        # so many of the shingles before each place are repeated ones
        many = [np.append(0, np.cumsum(np.isin(z, w))).tolist() if len(w) else [0] * (len(z) + 1) for z, w in zip((x, y), again, strict=True)]
        # a shingle that y repeats follows its predecessor where it can
        place, next_y, spots = to.tolist(), y.tolist(), at.tolist()
        for k in np.flatnonzero(np.isin(x[at], again[1])).tolist():
            if k and spots[k] == spots[k - 1] + 1 and place[k - 1] + 1 < len(next_y) and next_y[place[k - 1] + 1] == x[spots[k]]:
                place[k] = place[k - 1] + 1
        to = np.array(place)

    def parts(cut):
        cuts = np.flatnonzero(cut) + 1
        return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True))

    # so many shingles that occur once have two runs in common that verify
    need = -(-2 * threshold * least // (100 + threshold)) if once else 1
    wide = np.maximum(np.diff(at), np.abs(np.diff(to)))
    out, done, todo = [], np.zeros(len(at), bool), parts(wide > gap)
    while todo:
        a, b = todo.pop()
        p, q = int(at[a]), int(at[b - 1]) + 1
        if q - p < least or b - a < need:
            continue
        u, v = int(to[a:b].min()), int(to[a:b].max()) + 1
        if v - u < least:
            continue
        if once or (many[0][p] == many[0][q] and many[1][u] == many[1][v]):
            inter, total = b - a, (q - p) + (v - u)
        else:
            own, other = np.unique(x[p:q]), np.unique(y[u:v])
            inter, total = len(np.intersect1d(own, other, assume_unique=True)), len(own) + len(other)
        if inter * 100 >= threshold * (total - inter):
            out.append((p, q, u, v))
            done[a:b] = True
        else:
            k = a + int(wide[a : b - 1].argmax()) + 1
            if wide[k - 1] > 1:
                todo += [(a, k), (k, b)]
    for a, b in parts((np.diff(at) != 1) | (np.diff(to) != 1)):
        if b - a >= least and not done[a:b].all():
            out.append((int(at[a]), int(at[b - 1]) + 1, int(to[a]), int(to[b - 1]) + 1))
    return out


FOUND = "a bigint, b bigint, first_a bigint, end_a bigint, first_b bigint, end_b bigint"


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The passages (``FOUND``) around pairs of windows (a, b, w)."""
    many = C.materialise(pairs, "agreeing").where("a < b")
    both = many.join(texts.select(F.col("id").alias("a"), F.col("raw").alias("raw_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("raw").alias("raw_b")), "b")

    def side(batch, name):
        """Shingles of the different texts of one side, and which of them each row has."""
        ids, first, own = np.unique(batch.column(name).to_numpy(), return_index=True, return_inverse=True)
        raw = batch.column(f"raw_{name}").take(pa.array(first))
        values, places = shingled(*C.flat(raw))
        # rows of one id with several texts
        same = batch.column(f"raw_{name}").equals(raw.take(pa.array(own))) if len(ids) < len(batch) else True
        if not same:
            values, places = shingled(*C.flat(batch.column(f"raw_{name}")))
            own = np.arange(len(batch))
        return values, places, own

    def work(batches):
        for batch in batches:
            out = []
            (xs, x_at, x_own), (ys, y_at, y_own) = side(batch, "a"), side(batch, "b")
            lists = batch.column("w")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            wa, wb = (v.to_numpy() for v in lists.flatten().flatten())
            table = np.stack([wa >> BITS, wa & LOW, wb >> BITS, wb & LOW], axis=1)
            at = 0
            for i, (a, b, to) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), ends, strict=True)):
                x, y = xs[x_at[x_own[i]] : x_at[x_own[i] + 1]], ys[y_at[y_own[i]] : y_at[y_own[i] + 1]]
                w = sorted(table[at:to].tolist())
                at, k = to, 0
                while k < len(w):  # interval join: windows that overlap in a
                    p, q, u, v, j = *w[k], k + 1
                    while j < len(w) and w[j][0] <= q:
                        q, u, v = max(q, w[j][1]), min(u, w[j][2]), max(v, w[j][3])
                        j += 1
                    # a passage may go on where its windows do not agree
                    p, u = max(0, p - width), max(0, u - width)
                    out += [(a, b, p + s, p + e + SHINGLE - 1, u + m, u + n + SHINGLE - 1) for s, e, m, n in passages_of(x[p : q + 1 + width], y[u : v + 1 + width], width)]
                    k = j
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(6)], names=["a", "b", "first_a", "end_a", "first_b", "end_b"])

    return C.mapped(both.select("a", "b", "w", "raw_a", "raw_b"), work, FOUND)


def sides_of(found: DataFrame) -> DataFrame:
    return found.select(F.col("a").alias("id"), F.col("first_a").alias("first"), F.col("end_a").alias("end")).unionByName(found.select(F.col("b").alias("id"), F.col("first_b").alias("first"), F.col("end_b").alias("end"))).distinct()


def left_out(members: DataFrame, found: DataFrame) -> DataFrame:
    """(hub, id, label, open, w): the documents of each key that what was found does not settle, under the key's
    least document (hub); ``w`` has the windows that a document has in the keys of a hub, ``open`` the places outside passages."""
    sides = sides_of(found).groupBy("id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    known = sides.join(components(found.select("a", "b")), "id")
    bare = F.filter("w.wb", lambda at: ~F.coalesce(F.exists("spans", lambda x: (x["first"] <= at) & (at + SHINGLE <= x["end"])), F.lit(False)))
    state = C.materialise(members.join(known, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"), bare.alias("open"), F.col("w.wa").alias("w")), "state")
    keys = state.groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.size("open")).alias("bare"), F.min("id").alias("hub")).where("n > 2 AND (lo < hi OR bare > 0)").select("key", "hub")
    own = state.join(keys, "key").groupBy("hub", "id").agg(F.first("label").alias("label"), *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("open", "w")))
    return C.materialise(own, "unsettled")


#: A stretch of a document's text: its first word's place, and the text itself.
STRETCH = "hub bigint, id bigint, label bigint, open array<bigint>, at bigint, raw binary"


def stretches(own: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The text around the windows of each row (``STRETCH``); those that touch are one."""

    def cut(batches):
        for batch in batches:
            data, places = C.flat(batch.column("raw"))
            starts, ends, at = C.spans(data, places, C.NOT_SPACE)
            row, first, raw = [], [], []
            for i, windows in enumerate(batch.column("w").to_pylist()):
                n = int(at[i + 1] - at[i]) - SHINGLE + 1
                joined: list[list[int]] = []
                for lo, hi in sorted((max(0, (w >> BITS) - width), min(n, (w & LOW) + 1 + width)) for w in windows):
                    if joined and lo <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], hi)
                    elif lo < hi:
                        joined.append([lo, hi])
                for lo, hi in joined:
                    row.append(i)
                    first.append(lo)
                    raw.append(data[starts[at[i] + lo] : ends[at[i] + hi + SHINGLE - 2]].tobytes())
            yield C.with_column(C.with_column(batch.select(["hub", "id", "label", "open"]).take(pa.array(row, pa.int64())), "at", pa.array(first, pa.int64())), "raw", pa.array(raw, pa.binary()))

    return C.mapped(own.join(texts, "id").select("hub", "id", "label", "open", "w", "raw"), cut, STRETCH)


def alike(values: np.ndarray, places: np.ndarray, least: int):
    """(rows, first, part): rows of stretches that differ only in shingles that no other has, the place of the first
    shingle that others have, and each row's shingles from there to the last such.  Rows too short for a passage are left out."""
    code = np.unique(values, return_inverse=True)[1].astype(np.int64)
    row = np.repeat(np.arange(len(places) - 1), np.diff(places))
    order = np.lexsort((row, code))
    new = np.append(True, (code[order][1:] != code[order][:-1]) | (row[order][1:] != row[order][:-1]))[: len(order)]
    others = np.bincount(code[order][new], minlength=1) > 1
    distinct = np.bincount(row[order][new], minlength=len(places) - 1)  # of each row
    has = np.bincount(row[order][new & others[code[order]]], minlength=len(places) - 1)
    repeats = distinct < np.diff(places)
    found: dict[bytes, list] = {}
    for i in np.flatnonzero(np.where(repeats, has > 0, has * 100 >= THRESHOLD * least)).tolist():
        own = code[places[i] : places[i + 1]]
        at = np.flatnonzero(others[own])
        part = own[at[0] : at[-1] + 1]
        if len(part) < least:
            continue
        # shingles of its own count by the place where they come first
        _, first, back = np.unique(part, return_index=True, return_inverse=True) if repeats[i] else (None, np.arange(len(part)), np.arange(len(part)))
        found.setdefault(np.where(others[part], part, -1 - first[back]).tobytes(), []).append((i, int(at[0]), part))
    return list(found.values())


def widest(at: np.ndarray, to: np.ndarray, k: int | None, least: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """The longest passage (over the k-th of them) of the common shingles of two stretches without repeats, whose places ``at`` and ``to`` both rise."""
    # common ones count 100 less the threshold, each other of either side the threshold
    n = np.arange(len(at))
    score = 100 * n + threshold * (n - (at - at[0]) - (to - to[0]))
    low, b = (np.minimum.accumulate(score), n) if k is None else (np.minimum.accumulate(score[: k + 1]), n[k:])
    a = np.searchsorted(-low, -(score[b] + 100 - threshold))
    a, b = a[a < len(low)], b[a < len(low)]
    ok = (at[b] - at[a] >= least - 1) & (to[b] - to[a] >= least - 1)
    if not ok.any():
        return []
    a, b = a[ok], b[ok]
    j = int((at[b] - at[a]).argmax())
    return [(int(at[a[j]]), int(at[b[j]]) + 1, int(to[a[j]]), int(to[b[j]]) + 1)]


def hopes(x: np.ndarray, kind: np.ndarray, ends: np.ndarray, different: np.ndarray, count: np.ndarray, levels: list[int], width: int):
    """For each shingle of flat stretches (``kind``; ``ends``: where each ends, ``different``: how many it has), in how many of the levels a passage over it is
    still possible with a stretch that has none of its stretch's shingles that ``count`` or fewer have, for count in ``levels``;
    and the number of the part (from the first level) that such passages can't leave.  Both for any stretch, and for one
    without repeats if its own stretch is too.

    At least ``THRESHOLD`` percent of the different shingles of a passage are common, and gaps between them are small."""
    start = np.append(True, x[1:] != x[:-1])
    start[np.append(0, ends[:-1])] = True
    # repeats of a shingle in a row count once; where it comes again later, only gaps and lengths are looked at
    first = np.flatnonzero(start)
    end, own, often = np.append(first[1:], len(x)), kind[first], count[x[first]]
    weight = np.where(np.bincount(own, minlength=len(ends)) == different, THRESHOLD, 0)[own]
    far = 400 * (len(x) + 1)

    def covered(at, price):
        """The shingles inside a run that is long enough and has enough of what is at ``at``; ``price``: of the gap before each."""
        cut = np.append(True, (own[at[1:]] != own[at[:-1]]) | (first[at[1:]] - end[at[:-1]] + 1 > GAP))
        rest = np.cumsum(100 - weight[at] - np.where(cut, 0, weight[at] * np.diff(at, prepend=at[0] - 1) - weight[at] + price)) - np.cumsum(cut) * far
        # the first place from which on enough is common; parts before are higher by ``far``
        p, q = first[at[np.searchsorted(-np.minimum.accumulate(rest), -(rest + 100 - weight[at]))]], end[at]
        ok = q - p >= width
        return np.cumsum(np.bincount(p[ok], minlength=len(x) + 1) - np.bincount(q[ok], minlength=len(x) + 1))[:-1] > 0

    def numbered(inside):
        return np.cumsum(np.append(True, (inside[1:] != inside[:-1]) | (kind[1:] != kind[:-1])))

    level, strict = np.zeros(len(x), np.int8), np.zeros(len(x), np.int8)
    part = own_part = np.zeros(len(x), np.int64)
    price = None
    for k, limit in enumerate(levels):
        at = np.flatnonzero(often > limit)
        if not len(at) or not (inside := covered(at, 0)).any():
            break
        level += inside
        price = price or prices(x, kind, count, np.diff(ends, prepend=0) == different, inside)
        narrow = inside & covered(at, price(limit)[first[at]])
        strict += narrow & (strict == k)
        if not k:
            part, own_part = numbered(inside), numbered(narrow)
    return (level, part), (strict, own_part)


def prices(x: np.ndarray, kind: np.ndarray, count: np.ndarray, once: np.ndarray, inside: np.ndarray):
    """A function of a limit: at each shingle after a gap, what the gap between the shingles that more have costs at least besides its
    own, in a passage with a stretch that has none of these: the shingles that stand between the two sides in the stretch where they
    are nearest, or common ones given up.  All of a passage is ``inside``.  Zero in a stretch with repeats, or with shingles that come in both orders."""
    size = int(x.max()) + 1
    some = np.flatnonzero(inside & (count[x] > 1) & once[kind])
    spans = []
    for d in range(1, GAP + 1):
        k = some[: np.searchsorted(some, len(x) - d)].astype(np.int32)
        spans.append(k[(kind[k] == kind[k + d]) & inside[k + d] & (count[x[k + d]] > 1)])
    found = [np.unique(x[k] * size + x[k + d]) for d, k in enumerate(spans, 1)]
    keys, at = np.unique(np.concatenate(found), return_inverse=True)
    # how far apart the two shingles of a key stand, a bit for each distance
    apart = np.zeros(len(keys), np.int64)
    np.bitwise_or.at(apart, at, np.repeat(1 << np.arange(1, GAP + 1), [len(f) for f in found]))
    turned = np.isin(keys % size * size + keys // size, keys)
    # the least distance in others: at the same one, what shingles of adjacent words have between them is equal too, and so no gap
    bits = np.arange(1 << GAP + 1)
    lowest = np.where(bits > 0, np.log2(np.maximum(bits & -bits, 1)).astype(np.int64), GAP + 1)
    ordered, between = once.copy(), []
    for d, k in enumerate(spans, 1):
        spot = np.searchsorted(keys, x[k] * size + x[k + d])
        ordered[kind[k[turned[spot]]]] = False
        between.append((THRESHOLD * (lowest[apart[spot] & ~(1 << d if d <= SHINGLE else 0)] - 1)).astype(np.int32))

    def price(limit):
        common = count[x] > limit
        gap = np.append(False, common[1:] & ~common[:-1] & (kind[1:] == kind[:-1]))
        gaps, have, most = np.cumsum(gap, dtype=np.int32), np.cumsum(common, dtype=np.int32), np.iinfo(np.int64).max
        out = np.where(gap, most, 0)
        for d, (k, cost) in enumerate(zip(spans, between, strict=True), 1):
            ok = (gaps[k + d] > gaps[k]) & common[k] & common[k + d]
            k, cost = k[ok], cost[ok]
            cost = (cost + 100 * (have[k + d] - have[k] - 1)) // (gaps[k + d] - gaps[k])
            for e in range(1, d + 1):
                inner = gap[k + e]
                np.minimum.at(out, k[inner] + e, cost[inner])
        return np.where((out < most) & ordered[kind], out, 0)

    return price


def passages_between(table: pa.Table, width: int) -> pa.Table:
    """The passages (``FOUND``) of the stretches of one hub.  Stretches that differ in nothing that others have are
    compared once for all of them; each of them then has a row with the first of the others'.

    Two stretches are compared where they may join classes, or cover a place that no passage covers yet.  Where a stretch
    has no passage by its commoner shingles alone (``hopes``), it is held only against those that share a rarer one."""
    raw = table.column("raw").combine_chunks()
    values, places = shingled(*C.flat(raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw))
    ids, label, at = (table.column(c).to_numpy() for c in ("id", "label", "at"))
    bare = table.column("open").to_pylist()
    kinds, out = alike(values, places, width), []
    labels = [{int(label[i]) for i, *_ in k} for k in kinds]
    sets = [np.unique(k[0][2]) for k in kinds]
    once = np.array([len(x) == len(k[0][2]) for x, k in zip(sets, kinds, strict=True)], bool)
    # shingles in common that a passage needs: of two stretches without repeats, of one
    both, one = -(-2 * THRESHOLD * width // (100 + THRESHOLD)), -(-THRESHOLD * width // 100)
    class_of: dict[int, int] = {}
    # the places of keys that no passage covers yet, and their shingles
    bare = [{r: int(k[0][2][r]) for i, p, part in k for x in bare[i] if 0 <= (r := x - int(at[i]) - p) < len(part)} for k in kinds]

    def least_of(x):
        while (to := class_of.get(x, x)) != x:
            class_of[x] = x = class_of.get(to, to)
        return x

    mark = np.zeros(int(max((x[-1] for x in sets), default=0)) + 1, bool)
    spot = np.zeros(len(mark), np.int64)

    def reach(i, j):
        """Where passages of i with j may lie: stretches of common shingles, with small gaps, that are long enough."""
        mark[sets[j]] = True
        at = np.flatnonzero(mark[kinds[i][0][2]])
        mark[sets[j]] = False
        cut = np.flatnonzero(np.diff(at) > GAP) + 1
        lo, hi = np.append(0, cut), np.append(cut, len(at))
        if not len(at):
            return []
        first, end = at[lo], at[hi - 1] + 1
        ok = (end - first >= width) & (hi - lo >= (both if once[i] and once[j] else 1))
        return list(zip(first[ok].tolist(), end[ok].tolist(), strict=True))

    def cover(i, p, q):
        bare[i] = {r: x for r, x in bare[i].items() if not p <= r < q}

    def tell(one, two, spans):
        (i, p, _), (j, q, _) = one, two
        if ids[i] == ids[j]:
            return
        class_of[least_of(int(label[i]))] = least_of(int(label[j]))
        for s, e, m, n in spans:
            x = (int(ids[i]), int(at[i]) + p + s, int(at[i]) + p + e + SHINGLE - 1)
            y = (int(ids[j]), int(at[j]) + q + m, int(at[j]) + q + n + SHINGLE - 1)
            x, y = min(x, y), max(x, y)
            out.append((x[0], y[0], *x[1:], *y[1:]))

    compared = set()

    def compare(i, j):
        i, j = min(i, j), max(i, j)
        if (i, j) in compared:
            return []
        compared.add((i, j))
        one, two = kinds[i][0][2], kinds[j][i == j][2]
        spans = passages_of(one, two, width)
        if not (once[i] and once[j]):  # what repeats is found from one side only
            spans = list({*spans, *((u, v, p, q) for p, q, u, v in passages_of(two, one, width))})
        keep(i, j, spans)
        return spans

    def keep(i, j, spans):
        one, two = kinds[i], kinds[j]
        if not spans:
            return
        for x in one[i == j :]:
            tell(x, two[0], spans)
        for y in two[1:] if i != j else ():
            tell(one[0], y, spans)
        # rows of one document are not compared, so only kinds of different documents count as covered
        if len({int(ids[k]) for k, *_ in one} | {int(ids[k]) for k, *_ in two}) == len(one) + len(two) * (i != j):
            for s, e, m, n in spans:
                cover(i, s, e)
                cover(j, m, n)

    def common_places(i, j):
        """Places of the common shingles of two kinds without repeats, and bounds of the parts between large gaps."""
        mark[sets[j]] = True
        spot[kinds[j][0][2]] = np.arange(len(sets[j]))
        at = np.flatnonzero(mark[kinds[i][0][2]])
        mark[sets[j]] = False
        to = spot[kinds[i][0][2][at]]
        cuts = np.flatnonzero((np.diff(at) > GAP) | (np.abs(np.diff(to)) > GAP)) + 1
        return at, to, [0, *cuts.tolist()], [*cuts.tolist(), len(at)]

    def join(i, j):
        """Whether two kinds have a passage."""
        if not (once[i] and once[j]):
            return bool(reach(i, j) and compare(i, j))
        at, to, *bounds = common_places(i, j)
        for lo, hi in zip(*bounds, strict=True):
            if hi - lo >= both and at[hi - 1] + 1 - at[lo] >= width:
                if (to[lo + 1 : hi] < to[lo : hi - 1]).any():
                    if compare(i, j):
                        return True
                elif spans := widest(at[lo:hi], to[lo:hi], None, width):
                    widen(i, j, spans[0])
                    return True
        return False

    def widen(i, j, span):
        """What a comparison finds, and the span (of i, of j) if it is not inside that."""
        p, q, u, v = span if i <= j else (*span[2:], *span[:2])
        if not any(a <= p and q <= b and c <= u and v <= d for a, b, c, d in compare(i, j)):
            keep(min(i, j), max(i, j), [(p, q, u, v)])

    def hold(i, j, r):
        """Look for a passage of i with j over the place r of i."""
        if once[i] and once[j]:
            at, to, lo, hi = common_places(i, j)
            k = int(np.searchsorted(at, r))
            c = int(np.searchsorted(lo, k, "right")) - 1
            lo, hi = lo[c], hi[c]
            if at[hi - 1] + 1 - at[lo] < width:
                return
            if (to[lo + 1 : hi] > to[lo : hi - 1]).all():
                for span in widest(at[lo:hi], to[lo:hi], k - lo, width):
                    widen(i, j, span)
                return
        if (min(i, j), max(i, j)) not in compared and any(p <= r < q for p, q in reach(i, j)):
            compare(i, j)

    for i in range(len(kinds)):
        if len(kinds[i]) > 1 and (len({least_of(x) for x in labels[i]}) > 1 or bare[i]):
            compare(i, i)

    # the kinds of each shingle
    x = np.concatenate([np.zeros(0, np.int64), *(k[0][2] for k in kinds)])
    ends = np.cumsum([len(k[0][2]) for k in kinds], dtype=np.int64)
    kind = np.repeat(np.arange(len(kinds)), [len(k[0][2]) for k in kinds])
    order = np.argsort(x, kind="stable")
    new = np.flatnonzero(np.append(True, (x[order][1:] != x[order][:-1]) | (kind[order][1:] != kind[order][:-1]))[: len(x)])
    code, who = x[order][new], kind[order][new]
    count = np.bincount(code, minlength=len(mark))
    to = np.cumsum(count)
    levels = [1]
    while levels[-1] * 16 < count.max(initial=0):
        levels.append(levels[-1] * 4)
    # of any two stretches, and of two without repeats
    ways = hopes(x, kind, ends, np.array([len(k) for k in sets]), count, levels, width) if len(x) else [(x, x)] * 2
    top = [np.maximum.reduceat(w[order], new) if len(new) else w for w, _ in ways]
    most_of = [np.maximum.reduceat(w, np.append(0, ends[:-1])) if len(x) else w for w, _ in ways]
    # how common what is around a shingle is
    near = np.append(0, np.cumsum(count[x]))
    place = order[new]
    common = near[np.minimum(place + width, ends[who])] - near[np.maximum(place - width, np.append(0, ends)[who])]

    def having(shingles):
        """Places in ``who`` of those that have the shingles."""
        n = count[shingles]
        return np.repeat(to[shingles] - np.cumsum(n), n) + np.arange(int(n.sum()))

    def shared(i, where, most):
        """Kinds that have one of the shingles of i there that ``most`` kinds have at most."""
        own = np.unique(where)
        return np.unique(who[having(own[(count[own] > 1) & (count[own] <= most)])])

    # classes: those of the largest are not held against each other
    of = np.array([least_of(min(k)) if len({least_of(x) for x in k}) == 1 else -1 - i for i, k in enumerate(labels)], np.int64)
    names, size = np.unique(of, return_counts=True)
    most = of == names[size.argmax()] if len(names) and names[size.argmax()] >= 0 else np.zeros(len(of), bool)
    for i in np.flatnonzero(~most & (most_of[0] > 0)).tolist():
        lo, hi = int(ends[i]) - len(kinds[i][0][2]), int(ends[i])
        found = np.zeros(len(kinds), np.int64)
        for way, (level, _) in enumerate(ways):
            fit = once if way and once[i] else ~once if once[i] else ~once | once if not way else None
            if fit is None or not most_of[way][i] or not fit.any():
                continue
            own = np.unique(x[lo:hi][level[lo:hi] > 0])
            rare = shared(i, own, levels[min(int(most_of[way][i]), len(levels) - 1)])
            found[rare[fit[rare]]] = 1
            if most_of[way][i] == len(levels):
                other = np.bincount(who[having(own)], minlength=len(kinds))
                np.maximum(found, np.where(fit & (other >= (np.where(once, both, one) if once[i] else np.where(once, one, 1))) & (most_of[way] == len(levels)), other, 0), out=found)
        order_of = np.flatnonzero(found)
        found = order_of[np.argsort(-found[order_of], kind="stable")]
        for j in found[most[found] | (found > i)].tolist():
            if of[j] != of[i] and join(i, j):
                old, now = (of[i], of[j]) if most[j] else (of[j], of[i])
                if min(old, now) >= 0:
                    of[of == old] = now
    # places that no passage covers
    for i in range(len(kinds)):
        lo = int(ends[i]) - len(kinds[i][0][2])
        for r, v in list(bare[i].items()):
            if r not in bare[i]:
                continue
            here, ok = np.arange(to[v] - count[v], to[v]), np.zeros(int(count[v]), bool)
            for way, (level, part) in enumerate(ways):
                fit, deep = once[who[here]] if once[i] else way > 0, int(level[lo + r])
                fit = here[fit if way else ~fit] if once[i] else here[:0] if way else here
                if len(fit) and deep:
                    own = x[lo : int(ends[i])][part[lo : int(ends[i])] == part[lo + r]]
                    ok[fit - here[0]] = np.isin(who[fit], shared(i, own, levels[min(deep, len(levels) - 1)])) | ((top[way][fit] == len(levels)) & (deep == len(levels)))
            here = here[ok]
            for j in who[here[np.argsort(-common[here], kind="stable")]].tolist():
                if j != i:
                    hold(i, j, r)
                    if r not in bare[i]:
                        break
    return pa.table({n: pa.array([o[k] for o in out], pa.int64()) for k, n in enumerate(("a", "b", "first_a", "end_a", "first_b", "end_b"))})


@contextmanager
def filtered(spark):
    """Inside, the rows of a large table that a join has no use for are mostly dropped before they are shuffled (Spark's
    runtime Bloom filters, which leave tables of less than 10 GB alone)."""
    name = "spark.sql.optimizer.runtime.bloomFilter."
    held = {name + k: spark.conf.get(name + k) for k in ("enabled", "applicationSideScanSizeThreshold", "creationSideThreshold")}
    try:
        for key, value in zip(held, ("true", "0", "1t"), strict=True):
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def shared(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, hashes: int = HASHES) -> DataFrame:
    """(a, b, first_a, end_a, first_b, end_b): verified passages, as word ranges of documents a < b."""
    body = C.text_of(text)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), body.alias("raw"))
    width = words - SHINGLE + 1
    # equal texts stand for each other: pairs of them need no look at the texts
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.xxhash64(body).alias("h1"), F.xxhash64(body, F.lit("text")).alias("h2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    named = C.materialise(named, "named")
    equal = named.groupBy("h1", "h2").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.max("n").alias("n")).where("lead < last AND n > 0")
    equal = C.materialise(named.drop("n").join(equal.drop("last"), ["h1", "h2"]).where("id <> lead").groupBy("id").agg(F.min(F.struct("lead", "n")).alias("of"), F.count_distinct("h1", "h2").alias("texts")).where("texts = 1").select("id", "of.lead", "of.n"), "equal")
    # an id with several texts stands for itself
    several = named.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("id")
    equal = equal.join(several, "id", "left_anti").join(several.withColumnRenamed("id", "lead"), "lead", "left_anti")
    tasks = C.deal(rows, "raw")
    met = C.materialise(meetings(rows, width, hashes, tasks), "met")
    # a copy's keys are those of its lead
    members = met.where("crowd").select(F.col("a").alias("key"), F.col("b").alias("id"), "w").join(equal.select("id"), "id", "left_anti")
    pairs = met.where("NOT crowd").groupBy("a", "b").agg(F.flatten(F.collect_list("w")).alias("w"))
    for x in "ab":
        pairs = pairs.join(equal.select(F.col("id").alias(x), F.col("lead").alias(f"lead_{x}")), x, "left").withColumn(x, F.coalesce(f"lead_{x}", x)).drop(f"lead_{x}")
    turned = F.transform("w", lambda v: F.struct(v["wb"].alias("wa"), v["wa"].alias("wb")))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") > F.col("b"), turned).otherwise(F.col("w")).alias("w"))
    pairs = pairs.groupBy("a", "b").agg(F.flatten(F.collect_set("w")).alias("w"))
    whole = equal.where(F.col("n") >= words).select(F.col("lead").alias("a"), F.col("id").alias("b"), F.lit(0).cast("bigint").alias("first_a"), F.col("n").cast("bigint").alias("end_a"), F.lit(0).cast("bigint").alias("first_b"), F.col("n").cast("bigint").alias("end_b"))
    with filtered(docs.sparkSession):
        found = C.materialise(verified(pairs, rows, width).unionByName(whole).distinct(), "first")
        near = stretches(left_out(members, found).where("hub <= id"), rows, width).repartition(tasks, "hub")
        rest = C.materialise(near.groupBy("hub").applyInArrow(lambda table: passages_between(table, width), FOUND), "rest")
    return found.unionByName(rest).distinct()


def passage_table(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """A row for each document: n_passages, n_words in them (overlaps once), and its class, the least id that passages reach."""
    found = C.materialise(shared(docs, text, key, **how), "passages")
    sides = sides_of(found)
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("first", "end"))), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("words"), F.lit(-1).cast("bigint").alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.when(x["first"] > s["to"], 1).otherwise(0)).cast("bigint").alias("n"),
            (s["words"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["first"], s["to"]))).cast("bigint").alias("words"),
            F.greatest(s["to"], x["end"]).alias("to"),
        ),
    )
    own = sides.groupBy("id").agg(merged.alias("m")).select("id", F.col("m.n").alias("n_passages"), F.col("m.words").alias("n_words"))
    labels = components(found.select("a", "b"))
    ids = docs.select(F.col(key), F.col(key).cast("bigint").alias("id"))
    return ids.join(own.join(labels, "id"), "id", "left").select(key, F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_words", F.lit(0)).alias("n_dup_words"), F.coalesce("label", "id").alias("class_id"))


def op7_compact_windows(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return passage_table(docs)

"""Exact self-join of word-shingle sets by Jaccard similarity: universe partition and pigeonhole.

Sizes fall into bands.  A scheme belongs to each band and splits the universe of shingle hashes into
segments, more than the largest difference ``H`` that a pair with its larger set in the band may have
while it links.  A set is cut by its own band's scheme, and by the next one's if a partner may be that
large.  ``H`` differences touch ``H`` segments at most, so of any ``H + 1`` segments a set has one, whole,
in common with every partner.  Every set is indexed with its segments of two shingles or more; one with
fewer than ``H + 1`` of them also with all its segments and their one-deletion neighbourhoods, which are
worth two differences each; one that is still short also with every shingle.

Allocation is by measured cost: signatures meet in their tasks, where it is counted how many different
sets have each, and the counts of those that are shared go back to their sets.  A set spends its
``H + 1`` where it costs least: signatures that nobody shares cost nothing, and a set that has ``H + 1`` of
these has no partner at all; else the cheapest shared ones make up the rest.  Only groups in which a
set looks for partners go on, so a frequent line, which few sets need to spend on, pairs up nobody.

From these groups: (1) every member with the group's first set, verified on the exact sets;
components of these links; (2) the sets that look for partners with members of other components
that sizes and parity sketches do not rule out.  Pairs inside a component need no check.  Near copies
share many groups with much the same members: for (2) such groups are merged where their union costs
fewer comparisons than each of them alone, so that a pair is made about once, not once a group.

Rows: null, empty and wordless texts have no shingles and link with nothing.  Texts of fewer words
than a shingle are one shingle.  Equal sets are one set throughout, so copies never pair up.
Rows with one id are one document, linked through any of its texts; a null id stands alone: it gets
the least id of its component, or null.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .components import components

SHINGLE = 5
THRESHOLD = 80
RATIO = 1.3
SLACK = 1.2
#: Bytes of text that are indexed at a time.
CHUNK = 3 << 20
TABLE = C.byte_table(20, lower=True)
#: Ids of rows without one lie above all others.
NO_ID = 1 << 62


def node(key: str, text: str):
    return F.coalesce(F.col(key).cast("bigint"), F.xxhash64(C.text_of(text)).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID)))


def difference(a: int, b: int, threshold: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return a + b - 2 * -(-threshold * (a + b) // (100 + threshold))


@cache
def widest(low: int, high: int, threshold: int) -> int:
    """The largest ``difference`` of two sizes whose sum is ``low`` to ``high``.  It isn't monotone in the
    sum, but grows with every 100 + threshold of it, so the last sums hold the maximum."""
    return max(difference(s, 0, threshold) for s in range(max(low, high - 99 - threshold), high + 1))


class Schemes:
    """Bands by their lower edges, and the number of segments of each band's scheme."""

    def __init__(self, threshold: int, most: int = 1 << 40):
        self.threshold, self.edges = threshold, [1]
        while self.edges[-1] < most:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * max(RATIO, 100 / threshold + 0.01))))
        self.segments = [int(np.ceil(SLACK * (widest(1, 2 * (e - 1), threshold) + 1))) + 2 for e in self.edges[1:]]

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, signatures needed) for each scheme that cuts a set of ``n``."""
        k = int(np.searchsorted(self.edges, n, "right")) - 1
        least, most = -(-n * self.threshold // 100), n * 100 // self.threshold
        top = self.edges[k + 1] - 1
        out = [(k, widest(n + least, n + min(most, top), self.threshold) + 1)]
        if most > top:
            out.append((k + 1, widest(n + top + 1, n + most, self.threshold) + 1))
        return out


def signatures(shingles: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(signatures, slots, deficits) of a sorted set of shingle hashes.

    A slot says what its set may spend a signature on: 0 nothing (it is only there to be found), else
    one more than (unit, worth two, scheme) in bits; units are segments or shingles.  A deficit, one
    for each scheme, is what has to be spent less what all of the set's units are worth together."""
    sigs, slots, deficits = [], [], [0, 0]
    token = C.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    with np.errstate(over="ignore"):
        for k, (band, need) in enumerate(schemes.of(len(shingles))):
            segment = (shingles >> np.uint64(32)) * np.uint64(schemes.segments[band]) >> np.uint64(32)
            first = np.flatnonzero(np.diff(segment, prepend=segment[:1] + np.uint64(1)))
            count = np.diff(np.append(first, len(shingles)))
            total = np.add.reduceat(token, first)
            place = (segment[first] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(4 * band)
            strong = count > 1
            unit = np.arange(len(first))
            slot = (unit << 2) + k + 1
            worth = int(strong.sum())
            covered = worth >= need
            sigs.append(total[strong] + place[strong])
            slots.append(slot[strong] if covered else np.zeros(worth, np.int64))
            if not covered:
                one = np.uint64(1)
                inside = np.repeat(strong, count)
                sigs += [total + place + one, (np.repeat(total + place, count) - token)[inside] + one]
                worth += len(first)
                enough = worth >= need
                slot += 2 * strong
                slots += [slot, np.repeat(slot, count)[inside]] if enough else [np.zeros(len(first) + int(inside.sum()), np.int64)]
                if not enough:
                    worth = len(token)
                    sigs.append(token + np.uint64(4 * band + 2))
                    slots.append((np.arange(len(token)) << 2) + k + 1)
            deficits[k] = need - worth
        return C.mix(np.concatenate(sigs)), np.concatenate(slots), deficits


def shingle_sets(data: np.ndarray, places: np.ndarray, size: int):
    """Sorted shingle hashes of each text of a batch."""
    starts, ends, at = C.spans(data, places, C.NOT_SPACE)
    words = C.hashes(data, starts, ends, TABLE)[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield C.distinct_shingles(words[a:b], size)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(shingles):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(shingles.sum().view(np.int64)), int(np.bitwise_xor.reduce(C.mix(shingles)).view(np.int64))


#: 64-bit words of a set's parity sketch: each shingle flips one bit, so the bits that two sketches
#: differ in are no more than the shingles that their sets differ in.
SKETCH = 8
#: Sets of more shingles than ``FINE_FROM`` have a second, longer sketch: in the short one their flips overlap.
FINE = 64
FINE_FROM = 200


def parity(shingles: np.ndarray, words: int = SKETCH) -> np.ndarray:
    bits = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def node_of(n: int, s1: int, s2: int) -> int:
    """64 bits that name a set in the join."""
    with np.errstate(over="ignore"):
        return int(C.mix(C.mix(np.array([s1 & C.MASK], np.uint64) + np.uint64(n)) + np.uint64(s2 & C.MASK)).view(np.int64)[0])


def set_table(rows: DataFrame, size: int) -> DataFrame:
    """(id, key, h, n, node, p0 …, fine) for rows (id, key, h, raw): the set's size, name and sketches."""

    def work(batches):
        for batch in batches:
            for piece in C.pieces(batch, "raw", CHUNK):
                sets, fine = [], []
                for x in shingle_sets(*C.flat(piece.column("raw")), size):
                    sets.append((len(x), node_of(len(x), *set_key(x)), *parity(x)))
                    fine.append(parity(x, FINE) if len(x) > FINE_FROM else None)
                sets = np.array(sets, np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("key"), piece.column("h"), *(pa.array(np.ascontiguousarray(c)) for c in sets.T), pa.array(fine, pa.list_(pa.int64()))], names=["id", "key", "h", *names, "fine"])

    names = ["n", "node", *(f"p{k}" for k in range(SKETCH))]
    return C.mapped(rows, work, f"id bigint, key {rows.schema['key'].dataType.simpleString()}, h bigint, " + ", ".join(f"{n} bigint" for n in names) + ", fine array<bigint>")


#: What comes from the tasks of the signatures: members (run, node) of groups, and for each set what it may spend there.
MET = "run bigint, node bigint, cost bigint, unit bigint, worth bigint, scheme int, deficit int"


def meetings(rows: DataFrame, size: int, threshold: int, tasks: int) -> DataFrame:
    """The groups of different sets that share a signature (cost null: a member), and what a set gains by
    looking there: ``worth`` of a unit's signatures at the cost of the group's size."""

    def index(batches):
        schemes = Schemes(threshold)
        for batch in C.gather(batches, "raw", CHUNK):
            found: dict[int, np.ndarray] = {}
            for x in shingle_sets(*C.flat(batch.column("raw")), size):
                if len(x):
                    found.setdefault(node_of(len(x), *set_key(x)), x)
            if not found:
                continue
            each = [signatures(x, schemes) for x in found.values()]
            sig, slot = (np.concatenate([x[k] for x in each]) for k in (0, 1))
            doc = np.repeat(np.arange(len(each), dtype=np.uint32), [len(x[0]) for x in each])
            lack = np.array([x[2] for x in each], "<i4")
            dest = (sig % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            sig, doc, slot, dest = sig[order] >> np.uint64(24), doc[order], slot[order], dest[order]
            edges = np.flatnonzero(np.diff(dest, prepend=-1))
            names, out = np.array(list(found), "<i8"), []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(dest)], strict=True):
                used, place = np.unique(doc[a:b], return_inverse=True)
                kind = "<u2" if max(len(used), int(slot[a:b].max()) + 1) <= 1 << 16 else "<u4"
                out.append((int(dest[a]), names[used].tobytes(), lack[used].tobytes(), place.astype(kind).tobytes(), slot[a:b].astype(kind).tobytes(), np.ascontiguousarray(sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in range(1, 6))], names=["dest", "nodes", "lacks", "places", "slots", "sigs"])

    def solve(held):
        sigs, nodes, slots, lacks = [], [], [], []
        for names, lack, places, slot, packed in held:
            own = np.frombuffer(packed, np.uint8).reshape(-1, 5)
            wide = np.zeros((len(own), 8), np.uint8)
            wide[:, :5] = own
            kind = "<u2" if len(places) == 2 * len(own) else "<u4"
            place = np.frombuffer(places, kind)
            sigs.append(wide.view("<u8").ravel())
            nodes.append(np.frombuffer(names, "<i8")[place])
            slots.append(np.frombuffer(slot, kind).astype(np.int64))
            lacks.append(np.frombuffer(lack, "<i4").reshape(-1, 2)[place, (slots[-1] - 1) & 1])
        sig, node, slot, lack = (np.concatenate(x) for x in (sigs, nodes, slots, lacks))
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        again = np.zeros(len(sig), bool)
        again[1:] = sig[1:] == sig[:-1]
        again[:-1] |= again[1:]
        order, sig = order[again], sig[again]
        inner = np.lexsort((node[order], sig))
        order, sig = order[inner], sig[inner]
        node, slot, lack = node[order], slot[order], lack[order]
        if not len(sig):
            return
        new_sig = np.append(True, sig[1:] != sig[:-1])
        new = new_sig | np.append(True, node[1:] != node[:-1])
        first = np.flatnonzero(new_sig)
        count = np.add.reduceat(new.astype(np.int64), first)
        with np.errstate(over="ignore"):
            name = C.mix(np.add.reduceat(np.where(new, C.mix(node.view(np.uint64)), np.uint64(0)), first) + count.astype(np.uint64)).view(np.int64)
        of = np.cumsum(new_sig) - 1
        ok = count[of] > 1
        # members, each different group once
        lead = np.zeros(len(first), bool)
        lead[np.unique(name, return_index=True)[1]] = True
        own = ok & new & lead[of]
        yield name[of][own], node[own], None
        # what may be spent: units worth one by group, those worth two each for itself
        spend = ok & (slot > 0)
        run, who, cost, unit = name[of][spend], node[spend], count[of][spend], (slot[spend] - 1) >> 2
        two, scheme, less = (slot[spend] - 1 >> 1 & 1) == 1, slot[spend] - 1 & 1, lack[spend]
        unit = np.where(two, unit, -1)
        order = np.lexsort((unit, run, scheme, who))
        run, who, cost, unit, two, scheme, less = (x[order] for x in (run, who, cost, unit, two, scheme, less))
        if not len(run):
            return
        new = np.append(True, (run[1:] != run[:-1]) | (who[1:] != who[:-1]) | (scheme[1:] != scheme[:-1]) | (unit[1:] != unit[:-1]))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(run)))
        yield run[first], who[first], (cost[first], unit[first], np.where(two[first], 2, many), scheme[first], less[first])

    def batches_of(held):
        for run, who, spent in solve(held):
            none = pa.nulls(len(run), pa.int64())
            cost, unit, worth, scheme, lack = (none, none, none, none.cast(pa.int32()), none.cast(pa.int32())) if spent is None else (pa.array(x.astype(k)) for x, k in zip(spent, ("i8", "i8", "i8", "i4", "i4"), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(who), cost, unit, worth, scheme, lack], names=["run", "node", "cost", "unit", "worth", "scheme", "deficit"])

    def meet(batches):
        held, at = [], None
        for batch in batches:
            for dest, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and dest != at:
                    yield from batches_of(held)
                    held = []
                at = dest
                held.append(own)
        if held:
            yield from batches_of(held)

    packed = C.mapped(rows.select("raw"), index, "dest int, nodes binary, lacks binary, places binary, slots binary, sigs binary")
    return C.mapped(packed.repartition(tasks, "dest").sortWithinPartitions("dest"), meet, MET)


def allocated(met: DataFrame) -> DataFrame:
    """(run, node): the groups in which each set looks for partners, those of least cost that make up its need."""
    lists = met.where("cost IS NOT NULL").groupBy("node", "scheme").agg(F.min("deficit").alias("deficit"), F.collect_list(F.struct("cost", "run", "unit", "worth")).alias("offers"))

    def work(batches):
        for batch in batches:
            offers = batch.column("offers")
            ends = np.cumsum(offers.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            cost, run, unit, worth = (x.to_pylist() for x in offers.flatten().flatten())
            runs, nodes = [], []
            at = 0
            for node, deficit, to in zip(batch.column("node").to_pylist(), batch.column("deficit").to_pylist(), ends, strict=True):
                items: dict[tuple, list] = {}  # (unit) or (none, run): cost, worth, groups
                for k in range(at, to):
                    item = items.setdefault((unit[k], 0 if unit[k] >= 0 else run[k]), [0, 0, []])
                    item[0] += cost[k]
                    item[1] = worth[k] if unit[k] >= 0 else item[1] + worth[k]
                    item[2].append(run[k])
                at = to
                left = deficit + sum(x[1] for x in items.values())
                if left <= 0:
                    continue
                own = set()
                for price, value, where in sorted(items.values(), key=lambda x: x[0] / x[1]):
                    own.update(where)
                    left -= value
                    if left <= 0:
                        break
                runs += own
                nodes += [node] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(nodes, pa.int64())], names=["run", "node"])

    return C.mapped(lists, work, "run bigint, node bigint").distinct()


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets link.  Both texts meet in sort-merge joins, which split hot sets."""
    def side(x):
        one = nodes.select(F.col("node").alias(x), F.col("row.id").alias(f"id_{x}"), F.col("row.h").alias(f"h_{x}"))
        return one, rows.select(F.col("id").alias(f"id_{x}"), F.col("h").alias(f"h_{x}"), F.col("raw").alias(f"raw_{x}"))

    both = pairs
    for x in "ab":
        one, texts = side(x)
        both = both.join(one, x).join(texts, [f"id_{x}", f"h_{x}"])

    def work(batches):
        known: dict[bytes, np.ndarray] = {}  # the sets of the last texts: one side repeats

        def of(body: bytes) -> np.ndarray:
            if body not in known:
                if len(known) > 16:
                    known.pop(next(iter(known)))
                known[body] = next(shingle_sets(np.frombuffer(body, np.uint8), np.array([0, len(body)]), size))
            return known[body]

        for batch in batches:
            keep = np.zeros(len(batch), bool)
            left, right = batch.column("raw_a"), batch.column("raw_b")
            for i in range(len(batch)):
                x, y = of(left[i].as_py()), of(right[i].as_py())
                if len(x) > len(y):
                    x, y = y, x
                if len(x) * 100 < threshold * len(y) or not len(x):
                    continue
                at = np.searchsorted(y, x)
                inter = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[i] = inter * 100 >= threshold * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return C.mapped(both.select("a", "b", "raw_a", "raw_b"), work, "a bigint, b bigint").distinct()


def merged(groups: DataFrame) -> DataFrame:
    """(group, kind, node, seeks, label): the groups (run, node, seeks, label) that hold several labels, each
    merged with those of the same commonest label and about its size where the union costs no more
    comparisons than they do alone.  Every pair that shares a run shares a group."""
    runs = groups.groupBy("run").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.mode("label").alias("main"), F.count("*").alias("n"), F.count("seeks").alias("s"))
    runs = runs.where("lo < hi").select("run", "main", F.floor(F.log2("n")).cast("int").alias("kind"), (F.col("n") * F.col("s")).alias("cost"))
    open_runs = C.materialise(groups.join(runs, "run"), "open")
    unions = open_runs.groupBy("main", "kind", "node").agg(F.max("seeks").alias("seeks"), F.first("label").alias("label"))
    unions = C.materialise(unions, "unions")
    alone = open_runs.select("run", "main", "kind", "cost").distinct().groupBy("main", "kind").agg(F.sum("cost").alias("cost"))
    cheap = unions.groupBy("main", "kind").agg(F.count("*").alias("n"), F.count("seeks").alias("s")).join(alone, ["main", "kind"]).where(F.col("n") * F.col("s") <= F.col("cost")).select("main", "kind")
    cheap = C.materialise(cheap, "cheap")
    joined = unions.join(cheap, ["main", "kind"]).select(F.col("main").alias("group"), "kind", "node", "seeks", "label")
    rest = open_runs.join(cheap, ["main", "kind"], "left_anti").select(F.col("run").alias("group"), F.lit(-1).alias("kind"), "node", "seeks", "label")
    return joined.unionByName(rest)


def crossing(members: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b, for members (group, kind, node, seeks, label, n, sketches): who looks for partners with those
    of other labels that sizes and sketches do not rule out; once for each group that both are in."""
    bits = [f"p{k}" for k in range(SKETCH)]
    left = members.where("seeks").select("group", "kind", *(F.col(c).alias(f"a_{c}") for c in members.columns if c not in ("group", "kind")))
    right = members.select(F.col("group").alias("other"), F.col("kind").alias("other_kind"), *(F.col(c).alias(f"b_{c}") for c in members.columns if c not in ("group", "kind")))
    total = F.col("a_n") + F.col("b_n")
    most = total - 2 * F.ceil(total * threshold / (100 + threshold))
    differ = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in bits[1:]), F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))))
    apart = F.aggregate(F.zip_with("a_fine", "b_fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    once = F.col("b_seeks").isNull() | (F.col("a_node") < F.col("b_node"))
    pairs = left.join(right, (F.col("group") == F.col("other")) & (F.col("kind") == F.col("other_kind")) & (F.col("a_label") != F.col("b_label")) & once & (F.abs(F.col("a_n") - F.col("b_n")) <= most) & (differ <= most) & (F.coalesce(apart, F.lit(0)) <= most))
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def links(rows: DataFrame, sets: DataFrame, size: int, threshold: int) -> DataFrame:
    """(id, label): the components of nodes, where they have more than one."""
    bits = [f"p{k}" for k in range(SKETCH)]
    nodes = C.materialise(sets.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "h")).alias("row"), F.first("n").alias("n"), *(F.first(p).alias(p) for p in (*bits, "fine"))), "nodes")
    met = C.materialise(meetings(rows, size, threshold, C.deal(rows, "raw")), "met")
    seeking = C.materialise(allocated(met), "seeking")
    groups = met.where("cost IS NULL").select("run", "node").distinct()
    groups = C.materialise(groups.join(seeking.select("run").distinct(), "run").join(seeking.withColumn("seeks", F.lit(True)), ["run", "node"], "left"), "groups")
    least = groups.groupBy("run").agg(F.min("node").alias("a"))
    stars = C.materialise(groups.join(least, "run").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "stars")
    # one id with several texts is one document
    several = sets.where("n > 0").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("hi"), F.collect_set("node").alias("all")).where("a < hi")
    several = several.select("a", F.explode("all").alias("b")).where("a <> b")
    first = C.materialise(verified(stars, rows, nodes, size, threshold).unionByName(several).distinct(), "links")
    labels = components(first)
    named = groups.join(labels.withColumnRenamed("id", "node"), "node", "left").select("run", "node", "seeks", F.coalesce("label", "node").alias("label"))
    members = C.materialise(merged(named).join(nodes.drop("row"), "node"), "members")
    if members.isEmpty():
        return labels
    cross = crossing(members, threshold).distinct()
    cross = C.materialise(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    second = C.materialise(verified(cross, rows, nodes, size, threshold), "links2")
    if second.isEmpty():
        return labels
    return components(first.unionByName(second))


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(key, n, component, id, label) for each row: the set's size, the least key that links reach from
    it, and the same with the ids that stand for rows without a key."""
    raw = C.text_of(text)
    rows = docs.select(node(key, text).alias("id"), F.col(key).alias("key"), F.xxhash64(raw).alias("h"), raw.alias("raw"))
    sets = C.materialise(set_table(rows, size), "sets")
    full = sets.where("n > 0").select("id", "key", "n", "node").join(links(rows, sets, size, threshold).select(F.col("id").alias("node"), "label"), "node", "left")
    full = full.select("key", "n", "id", F.coalesce("label", "node").alias("own"))
    done = full.join(full.groupBy("own").agg(F.min("id").alias("label")), "own").select("key", "n", "id", "label")
    alone = sets.where("n = 0").select("key", "n", "id", F.col("id").alias("label"))
    number = F.when(F.col("label") < NO_ID, F.col("label"))
    return done.unionByName(alone).select(F.col("key").alias(key), "n", number.alias("component"), "id", "label")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the least id (of repeated rows, one)."""
    name = C.fresh("id", docs.columns)
    kept = similar(docs).where("id = label").select(F.col("id").alias(name)).distinct()
    return docs.withColumn(name, node("doc_id", "text")).join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[j : j + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS j FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.other)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""

"""Each operator against brute force on the smallest tables and on odd rows: nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from tidemark.llm import common as C
from tidemark.llm import decontaminate, jaccard, language, licenses, packing, passages, quality, sharding, suffix_dedup, urls

RNG = random.Random(1)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_rows():
    base, item = prose(120), prose(30)
    words = base.split()
    return [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, None), (4, "one two", "de", "s"), (5, "one two", "de", "s"), (6, base, "en", "s"), (7, base, "en", "s"),
        (8, " ".join(words[:60] + ["x"] + words[60:]), "en", "s"), (9, prose(50) + " " + item.upper() + " " + prose(50), "en", "s"), (10, base + "\n" + prose(40), "en", "s"),
        (11, "é" * 500 + " " + "é" * 500, "fr", "s"), (12, prose(4000), "en", "t"), (13, "a" * 3000, "en", "t"), (14, "word " * 500, "en", "t"), (15, base + " " + base, "en", "t"),
    ], [(0, item), (1, item), (2, None), (3, ""), (4, "one two"), (None, " ".join(words[:20]))]


@pytest.fixture(scope="module")
def odd(spark):
    rows, items = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({"n_words": F.lit(7), "raw_text": F.lit("x"), "id": F.lit("y")})
    return docs, spark.createDataFrame(items, "item_id bigint, text string"), [(r[0], r[1]) for r in rows], items


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.where("doc_id < -1")


def hits(df):
    return sorted(tuple(r) for r in df.select("doc_id", "c.n_words", decontaminate.hit_words("c"), F.size("c.items"), F.sha2(F.concat_ws(",", "c.items"), 256), decontaminate.contaminated("c")).collect())


def test_decontamination(spark, odd, small, monkeypatch):
    docs, bench, rows, items = odd
    assert hits(decontaminate.contamination(docs, bench, out="c")) == sorted(brute.contamination(rows, items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)  # many blocks
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    found = decontaminate.contamination(docs, bench, out="c")
    assert hits(found) == sorted(brute.contamination(rows, items)) and found.columns[:-1] == docs.columns
    assert not any(r[2] for r in hits(decontaminate.contamination(docs, bench.where("item_id > 99"), out="c")))
    assert decontaminate.contamination(empty(docs), bench, out="c").count() == 0
    monkeypatch.undo()
    got = [tuple(r)[:6] for r in decontaminate.op1_suffix_decontamination(spark, DATA).collect()]
    assert sorted(got) == sorted(brute.contamination(small[1], [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]))


def test_longest_matches(odd):
    docs, bench, rows, _ = odd
    best = decontaminate.longest_matches(docs.where("doc_id = 9"), bench.where("item_id = 0")).orderBy("place").first()
    words = brute.ALNUM.findall(rows[8][1].translate(brute.LOW))
    assert (best["place"], best["length"], best["doc"], best["word"]) == (0, 30, 9, 50) and len(words) == 130


@pytest.mark.parametrize("block", [300, 4 << 20])
def test_longest_match_of_each_document(odd, monkeypatch, block):
    docs, bench, rows, items = odd
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    words = lambda t: brute.ALNUM.findall((t or "").translate(brute.LOW))
    want = []
    for doc, text, *_ in rows:
        own, best = words(text), None
        for item, told in items:
            other = words(told)
            for a in range(len(own)):
                for b in range(len(other)):
                    n = 0
                    while a + n < len(own) and b + n < len(other) and own[a + n] == other[b + n]:
                        n += 1
                    if n and n >= min(decontaminate.WINDOW, len(other)):
                        best = decontaminate.longer(best, (n, a, None if item is None else str(item), b))
        want.append((doc, best))
    got = [(r["doc_id"], r["longest"] and tuple(r["longest"])) for r in decontaminate.contamination(docs, bench, out="c").select("doc_id", "c.longest").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(b for _, b in want)


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    for _ in range(20):
        w = rng.integers(0, 4, 60).astype(np.int32)
        got = decontaminate.suffix_array(w, 64)

        def key(p, w=w):
            rest = w[p:].tolist()
            return rest[: rest.index(0)] if 0 in rest else rest

        assert sorted(got.tolist()) == np.flatnonzero(w).tolist()
        assert [key(p) for p in got] == sorted(key(p) for p in got)


def test_quality_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(tuple(r) for r in quality.op2_line_frequency(spark, DATA).collect()) == sorted(con.execute(quality.SQL).fetchall())


def test_quality_odd_rows(odd):
    docs = odd[0]
    got = {r["doc_id"]: r for r in quality.judge(docs.drop("n_words"), max_docs=1).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and got[1]["base_failed"]
    assert got[6]["n_removed_words"] == 120 and not got[6]["kept"] and got[12]["kept"] and got[14]["base_failed"] and got[11]["word_chars"] == 1000
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(docs.drop("n_words"), max_docs=1, least=0.2).collect()}
    assert 6 not in cleaned and cleaned[10] == odd[2][9][1].split("\n")[1]
    assert quality.judge(empty(docs).drop("n_words")).count() == 0


def test_quality_clashing_columns(odd):
    docs = odd[0].withColumns({"lines": F.lit(1), "kept": F.lit("k"), "row_number": F.lit(5), "word_chars": F.lit("c"), "base_failed": F.lit(0), "n_removed_words": F.lit(2)})
    found = quality.judge(docs, max_docs=1)
    plain = {r["doc_id"]: tuple(r)[-8:] for r in quality.judge(odd[0].select("doc_id", "source", "text"), max_docs=1).collect()}
    rows = found.collect()
    assert found.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "text"] and len(rows) == len(odd[2])
    assert all(tuple(r)[-8:] == plain[r["doc_id"]] and r["n_words"] == 7 and r["row_number"] == 5 and r["kept"] == "k" for r in rows)
    assert quality.clean(odd[0], max_docs=1, least=0.2).columns == odd[0].columns


def test_jaccard(odd, small, monkeypatch):
    docs, _, rows, _ = odd
    for d, own in ((docs, rows), (small[0], small[1])):
        assert {r[0]: (r[1], r[2]) for r in jaccard.similar(d).select("doc_id", "n", "component").collect()} == brute.components(own)
    assert jaccard.similar(empty(docs)).count() == 0


def test_jaccard_misses_nothing_near_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        words = [f"w{g}_{k}" for k in range(rng.choice([3, 6, 9, 14, 25, 60]))]
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard.similar(docs).select("doc_id", "n", "component").collect()} == brute.components(rows)


def test_jaccard_schemes_cover_all_linked_sizes():
    for threshold in (50, 70, 80, 90):
        schemes = jaccard.Schemes(threshold, 1000)
        need = {n: dict(schemes.of(n)) for n in range(1, 400)}
        for a in need:
            for b in range(a, min(399, a * 100 // threshold) + 1):
                differ = jaccard.difference(a, b, threshold)
                assert any(min(need[a][k], need[b][k]) > differ for k in need[a].keys() & need[b].keys()), (threshold, a, b)


def test_jaccard_linked_sizes_meet():
    rng = np.random.default_rng(5)
    schemes = jaccard.Schemes(80)
    for a in range(1, 61):
        for b in range(a, a * 100 // 80 + 1):
            differ = jaccard.difference(a, b, 80)
            extra = (differ - (b - a)) // 2  # replaced on both sides: 0 is a set inside the other
            for gone in {0, extra}:
                for _ in range(8):
                    x = rng.integers(0, 1 << 63, b + gone).astype(np.uint64) * np.uint64(2)
                    one, two = np.sort(np.append(x[: a - gone], x[b : b + gone])), np.sort(x[:b])
                    assert len(np.intersect1d(jaccard.signatures(one, schemes)[0], jaccard.signatures(two, schemes)[0])), (a, b, gone)


def test_jaccard_links_appended_words(spark):
    rows = []
    for n in [*range(5, 33), 37, 42]:
        for g in range(4):
            own = [f"v{n}_{g}_{k}" for k in range(n + 1)]
            rows += [(len(rows), " ".join(own[:-1])), (len(rows) + 1, " ".join(own))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard.similar(docs).select("doc_id", "n", "component").collect()} == brute.components(rows)


def test_jaccard_makes_pairs_of_near_copies_once(spark):
    rng, rows = random.Random(12), []
    for run in range(30):  # near copies: 30 groups of much the same 40 sets, of two components
        rows += [(run, k, True if k % 3 else None, k % 2) for k in range(40) if k != rng.randrange(40)]
    rows += [(99, k, True if k == 7 else None, k) for k in (7, 8, *range(100, 400))]  # and a frequent line that one set looks at
    groups = spark.createDataFrame(rows, "run bigint, node bigint, seeks boolean, label bigint")
    sketches = [F.lit(0).cast("bigint").alias(f"p{k}") for k in range(jaccard.SKETCH)]
    members = jaccard.merged(groups).select("*", F.lit(300).cast("bigint").alias("n"), *sketches, F.lit(None).cast("array<bigint>").alias("fine"))
    got = [tuple(r) for r in jaccard.crossing(members, 80).collect()]
    by_run = collections.defaultdict(list)
    for r in rows:
        by_run[r[0]].append(r[1:])
    want = {(min(x, y), max(x, y)) for own in by_run.values() for x, seeks, k in own for y, _, m in own if seeks and k != m}
    assert set(got) == want and len(got) <= 2 * len(want)


def test_jaccard_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u v")], "doc_id bigint, text string")
    assert sorted(((r[0], r[2]) for r in jaccard.similar(docs).select("doc_id", "n", "component").collect()), key=repr) == sorted([(None, 3), (3, 3), (None, None)], key=repr)


def pieces_are_right(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {d: [*(tokenizer.encode(t or "", add_special_tokens=False).ids), 1] for d, t in docs}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing(spark, odd, small):
    docs, _, rows, _ = odd
    special = [(100, "a<|endoftext|>b"), (101, "<|endoftext|>"), (102, "tab\tand  two spaces あ\U0001f600")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id bigint, text string"))
    pieces_are_right(packing.packing_stage(spark, more, DATA).collect(), rows + special)
    pieces_are_right(packing.op4_spfhp_packing(spark, DATA).collect(), small[1])
    assert packing.packing_stage(spark, empty(docs), DATA).count() == 0


def test_plan_places_every_length():
    histogram = {n: RNG.randint(1, 50) for n in range(1, 2049, 7)}
    plan = packing.plan(histogram)
    placed = collections.Counter()
    for copies, parts in plan:
        assert sum(n * k for n, k in parts) <= 2048
        for n, k in parts:
            placed[n] += copies * k
    assert placed == histogram


def test_sharding(odd, small):
    for d, text in ((odd[0], odd[2]), (small[0], small[1])):
        rows = sharding.shard(d, shards=4).collect()
        size = {i: len((t or "").encode()) + 16 for i, t in text}
        assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t in text}
        slots, total = collections.defaultdict(list), collections.Counter()
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            total[r["shard"]] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(4))
        assert max(total.values()) <= sum(size.values()) / 4 + 2 * max(size.values())
    assert sharding.shard(empty(odd[0])).count() == 0


def test_sharding_splits_a_hot_text(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(3000)], "doc_id bigint, text string")
    total = collections.Counter()
    for r in sharding.shard(docs, shards=10).collect():
        total[r["shard"]] += r["size"]
    assert max(total.values()) - min(total.values()) <= 60


def test_licenses(odd, spark):
    mit = licenses.TEMPLATES["MIT"]
    docs = spark.createDataFrame([(1, prose(50) + " " + mit + " " + prose(40)), (2, mit.replace("without", "with")), (3, prose(500)), (4, None), (5, f"{prose(9)}\nReleased under the MIT License.\n{prose(9)}\nReleased under the MIT License.")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["scan"] for r in licenses.scan(docs).collect()}
    first = got[1]["licenses"][0]
    assert (first["name"], first["coverage"], first["start"], first["end"]) == ("MIT", 1.0, 50, 50 + len(licenses.words(mit)))
    assert got[2]["licenses"][0]["name"] == "MIT" and got[2]["licenses"][0]["coverage"] > 0.95 and got[3]["licenses"] == [] and got[4]["n_words"] == 0 and got[5]["licenses"][0]["name"] == "MIT line"
    assert licenses.scan(odd[0]).columns[:-1] == odd[0].columns and licenses.scan(empty(odd[0])).count() == 0
    a, b = prose(40).split(), prose(60).split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_licenses_without_their_rarest_word(spark):
    gone = licenses.TEMPLATES["MIT"].replace("sublicense", "x")
    texts = [
        f"{prose(30)} under the MIT License {prose(60)} under the MIT License {prose(300)} released {prose(20)}",
        f"{prose(40)} {gone} {prose(900)} sublicense {prose(900)}",
        f"{prose(900)} Released {prose(50)}",
    ]
    got = {r["doc_id"]: [x["name"] for x in r["scan"]["licenses"]] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: ["MIT line"], 1: ["MIT"], 2: []}


def test_passages_find_exact_repeats(spark, small):
    runs = collections.defaultdict(set)
    for d, t in small[1]:
        w = brute.SPACED.findall((t or "").translate(brute.LOW))
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].add(d)
    want = set().union(*(v for v in runs.values() if len(v) > 1))
    got = {r["doc_id"]: r for r in passages.op7_compact_windows(spark, DATA).collect()}
    assert len(got) == len(small[1]) and want <= {d for d, r in got.items() if r["n_passages"]}
    assert all(r["n_dup_words"] >= 50 for r in got.values() if r["n_passages"])


def test_compact_windows_are_the_long_nodes():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    places = np.array([0, 120, 120, 200])
    got = {tuple(x) for x in np.stack(passages.compact_windows(values, places, 10), axis=1).tolist()}
    want = set()
    for d in range(3):
        v = values[places[d] : places[d + 1]]
        todo = [(0, len(v) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a + 1 >= 10:
                c = a + int((v[a : b + 1] >> np.uint64(24)).argmin())
                want.add((d, a, c, b))
                todo += [(a, c - 1), (c + 1, b)]
    assert got == want


def test_passages_with_edited_words(spark):
    rng, rows, many = random.Random(6), [], 0

    def fresh(n):
        return [f"p{rng.random()}" for _ in range(n)]

    for trial in range(120):
        for n, edits, insert in ((60, 1, True), (52, 1, False), (100, 2, True)):
            own = fresh(n)
            other = list(own)
            for e in range(edits, 0, -1):
                at = e * n // (edits + 1)
                other[at : at + (not insert)] = fresh(1)
            rows += [(many, " ".join(fresh(40) + own + fresh(40))), (many + 1, " ".join(fresh(30) + other + fresh(60)))]
            many += 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in passages.passage_table(docs).collect()}
    for kind in range(3):
        caught = [got[k + 1] == k for k in range(2 * kind, many, 6)]
        assert sum(caught) >= 0.95 * len(caught), (kind, sum(caught), len(caught))


def test_passages_behind_an_unlike_lead(spark):
    rng, texts = random.Random(7), []

    def fresh(n):
        return [f"a{rng.random()}" for _ in range(n)]

    for _ in range(40):
        own = fresh(50)
        # the first holds two parts of the passage, both too short; the others share all of it
        texts += [fresh(20) + own[:45] + fresh(30) + own[5:] + fresh(20), fresh(30) + own + fresh(30), fresh(40) + own + fresh(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_passages"], r["class_id"]) for r in passages.passage_table(docs).collect()}
    assert got == {i: (int(i % 3 > 0), i - (i % 3 == 2)) for i in range(len(texts))}


@pytest.mark.parametrize("part", [30, 40, 45, 49])
def test_passages_beside_fragments(spark, part):
    rng, texts = random.Random(part), []

    def fresh(n):
        return [f"b{rng.random()}" for _ in range(n)]

    for _ in range(100):  # the first document holds a part of the passage that the two others share
        own, at = fresh(60), rng.randint(0, 60 - part)
        texts += [fresh(30) + own[at : at + part] + fresh(30), fresh(30) + own + fresh(30), fresh(40) + own + fresh(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in passages.passage_table(docs).collect()}
    assert sum(got[i + 1] == got[i + 2] for i in range(0, 300, 3)) >= 98


def test_passages_between_fragments(spark):
    rng, texts = random.Random(15), []

    def fresh(n):
        return [f"e{rng.random()}" for _ in range(n)]

    for _ in range(60):  # a fragment is the least document of the key, and another stands before the second that has all of the passage
        own = fresh(50)
        texts += [fresh(30) + part + fresh(30) for part in (own[:49], own, own[:49], own[1:], own[:49], own)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_passages"], r["class_id"]) for r in passages.passage_table(docs).collect()}
    assert got == {i: (int(i % 6 in (1, 5)), i - 4 if i % 6 == 5 else i) for i in range(len(texts))}


def test_passages_of_many_documents(spark):
    rng = random.Random(8)

    def fresh(n):
        return [f"c{rng.random()}" for _ in range(n)]

    own = fresh(70)
    texts = []
    for i in range(400):  # all share a passage, one word of which each has its own way
        other = list(own)
        other[rng.randrange(70)] = f"d{i}"
        texts.append(fresh(30) + other + fresh(30))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = passages.passage_table(docs).collect()
    assert sum(r["n_passages"] > 0 for r in rows) >= 392 and collections.Counter(r["class_id"] for r in rows).most_common(1)[0][1] >= 392


def test_passages_beside_a_common_line(spark, monkeypatch):
    rng, texts, sent = random.Random(21), [], []

    def fresh(n):
        return [f"g{rng.random()}" for _ in range(n)]

    line, own = fresh(40), fresh(60)
    for i in range(240):  # all hold a line too short for a passage, and some of them a passage around it
        texts.append(fresh(80) + (own[:20] + line + own[20:] if i % 60 == 30 else line) + fresh(80))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    held = C.materialise

    def watched(df, name):
        out = held(df, name)
        if name == "agreeing":
            sent.append(out.count())
        return out

    monkeypatch.setattr(C, "materialise", watched)
    got = {r["doc_id"]: (r["n_passages"], r["class_id"]) for r in passages.passage_table(docs).collect()}
    assert got == {i: (int(i % 60 == 30), 30 if i % 60 == 30 else i) for i in range(240)}
    assert sum(sent) <= 12 * len(texts)  # a few leads a document; all pairs would be 120 times the documents


def test_passages_between_stretches():
    rng, rows = random.Random(22), []

    def fresh(n):
        return [f"h{rng.random()}" for _ in range(n)]

    own, line = fresh(90), fresh(30)
    parts = [fresh(20) + own + fresh(9), fresh(3) + own + fresh(30), own[:49] + fresh(60), fresh(50) + line + fresh(50), fresh(50) + line + fresh(50), fresh(7) + own[:45] + fresh(1) + own[46:] + line]
    for i, words in enumerate(parts):
        rows.append({"hub": 0, "id": i, "label": i, "open": list(range(100, 100 + len(words))), "at": 100, "raw": " ".join(words).encode()})
    found = passages.passages_between(pa.Table.from_pylist(rows), 46).to_pylist()
    spans = collections.defaultdict(set)
    for r in found:
        spans[r["a"]].add((r["first_a"] - 100, r["end_a"] - 100))
        spans[r["b"]].add((r["first_b"] - 100, r["end_b"] - 100))
    assert spans == {0: {(20, 110)}, 1: {(3, 93)}, 5: {(7, 97)}}
    first = collections.Counter()
    for r in found:
        first[r["a"], r["b"]] += 1
    assert len(first) == len(found) >= 2  # each pair once, and all three are linked


def near_copies(rng, n, words, edits):
    """Texts of one, each with about one word in ``edits`` replaced, left out or doubled by another."""
    base, out = [f"w{i}" for i in range(words)], []
    for _ in range(n):
        own = []
        for w in base:
            kind = rng.integers(3) if rng.random() < 1 / edits else None
            own += [w] if kind is None else [] if kind == 0 else [f"e{rng.integers(60)}"] if kind == 1 else [w, f"e{rng.integers(60)}"]
        out.append(own)
    return out


def test_places_that_a_passage_can_cover_are_covered():
    rng = np.random.default_rng(3)
    texts = near_copies(rng, 30, 170, 30)
    rows = [{"hub": 0, "id": i, "label": 0, "open": list(range(len(t) - 4)), "at": 0, "raw": " ".join(t).encode()} for i, t in enumerate(texts)]
    got = collections.defaultdict(set)
    for r in passages.passages_between(pa.Table.from_pylist(rows), 46).to_pylist():
        got[r["a"]] |= set(range(r["first_a"], r["end_a"] - 4))
        got[r["b"]] |= set(range(r["first_b"], r["end_b"] - 4))
    shingles = [[tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in texts]
    assert all(len(set(x)) == len(x) for x in shingles)
    want, whole = collections.defaultdict(set), 0
    for i, j in itertools.permutations(range(len(texts)), 2):
        spot = {v: k for k, v in enumerate(shingles[j])}
        at = np.array([k for k, v in enumerate(shingles[i]) if v in spot])
        to = np.array([spot[shingles[i][k]] for k in at])
        part = np.cumsum(np.append(0, (np.diff(at) > 8) | (np.abs(np.diff(to)) > 8)))
        n, x, y = np.arange(len(at)), at[None] - at[:, None] + 1, to[None] - to[:, None] + 1
        common = n[None] - n[:, None] + 1
        for a, b in np.argwhere((part[None] == part[:, None]) & (x >= 46) & (y >= 46) & (100 * common >= 80 * (x + y - common))).tolist():
            want[i] |= set(at[a : b + 1].tolist())
    for i, x in enumerate(shingles):
        assert want[i] <= got[i]
        whole += len(want[i]) > len(x) - 20
    assert 3 < whole < 27  # of some all places can be covered, of others not


def test_near_copies_are_not_compared_in_all_pairs(monkeypatch):
    rng, counted = np.random.default_rng(5), []
    known = {n: getattr(passages, n) for n in ("passages_of", "widest") if hasattr(passages, n)}
    for name, work in known.items():
        monkeypatch.setattr(passages, name, lambda *x, work=work: counted.append(1) or work(*x))
    for n in (200, 800):
        rows = [{"hub": 0, "id": i, "label": 0 if i % 10 else i, "open": sorted(rng.integers(0, 150, 3).tolist()), "at": 0, "raw": " ".join(t).encode()} for i, t in enumerate(near_copies(rng, n, 170, 22))]
        counted.clear()
        found = passages.passages_between(pa.Table.from_pylist(rows), 46)
        # all pairs are 19,900 and 319,600
        assert len(counted) < 20 * n and n / 10 - 2 < len(found) < 5 * n


def test_passages_of_repeats_from_either_side():
    def run(*parts):
        return " ".join(" ".join([w] * n) for w, n in parts).encode()

    one, two = run(("a", 27), ("b", 27), ("c", 27), ("d", 27)), run(("c", 71), ("d", 71))
    for turned in (False, True):
        texts = [two, one] if turned else [one, two]
        rows = [{"hub": 0, "id": i, "label": i, "open": [], "at": 0, "raw": t} for i, t in enumerate(texts)]
        assert {(r["a"], r["b"]) for r in passages.passages_between(pa.Table.from_pylist(rows), 46).to_pylist()} == {(0, 1)}


def test_passages_null_ids_and_extra_columns(spark):
    text = prose(80)
    docs = spark.createDataFrame([(None, text, "x"), (1, text, "y"), (2, "z " + text, "z")], "doc_id bigint, text string, id string")
    got = sorted((tuple(r) for r in passages.passage_table(docs).select("doc_id", "n_passages", "class_id").collect()), key=repr)
    assert got == sorted([(None, 0, None), (1, 1, 1), (2, 1, 1)], key=repr)


def test_passages_odd_rows(odd):
    got = {r["doc_id"]: r["n_passages"] for r in passages.passage_table(odd[0]).collect()}
    assert got[6] and got[7] and got[8] and got[10] and not got[1] and not got[12]
    assert passages.passage_table(empty(odd[0])).count() == 0


def test_urls(spark):
    rows = [(1, "http://a.example.com/en/1"), (2, "https://WWW.example.com/en/1?x=1"), (3, "http://x.net/fr/"), (4, "http://y.org/spam/1"), (5, None), (6, "no scheme"), (7, "http://com"), (8, "http://z.org?q=://w"), (9, "ftp://b.com/x#/en/")]
    rows += [(100 + i, f"http://h{i % 7}.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(80)]
    labels = [(100 + i, 0 if i % 2 else 1, 0) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3)] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/fr/", "block")]
    assert (got[2]["host"], got[2]["path"]) == ("www.example.com", "/en/1") and (got[7]["host"], got[7]["path"], got[7]["rule"]) == ("com", "", None) and (got[8]["host"], got[8]["path"]) == ("z.org", "")
    assert (got[5]["host"], got[5]["path"], got[5]["verdict"]) == ("", "", "allow") == (got[6]["host"], got[6]["path"], got[6]["verdict"]) and got[9]["rule"] == "com/"
    assert all(got[100 + i]["verdict"] == ("block" if i % 2 else "allow") for i in range(80))
    bare = urls.judge(pages, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert bare.where("verdict = 'block' AND rule IS NULL").count() == 0


def test_urls_of_a_rare_class(spark):
    rng = random.Random(11)
    # a third of the pages of one host are bad, a twentieth of the others: far from a majority, and no chance
    rows = [(i, f"http://{'spam' if i % 4 == 0 else f'h{i % 13}'}.org/{'a' if rng.random() < 0.5 else 'b'}/x?q=1") for i in range(3000)]
    bad = {i: rng.random() < (0.4 if i % 4 == 0 else 0.05) for i in range(3000)}
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in bad.items() if i < 2000] + [(1, None, None), (None, 0, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([*rows, (5, rows[5][1]), (None, rows[4][1]), (9999, "http://" + "x" * 50000 + ".org/")], "page_id bigint, url string").withColumn("rule", F.lit("r"))
    got = urls.judge(pages, labels).collect()
    blocked = [r["page_id"] for r in got if r["verdict"] == "block" and r["page_id"] is not None and r["page_id"] < 3000]
    assert len(got) == 3003 and sorted(blocked) == [i for i in range(3000) if i % 4 == 0] and all(r["verdict"] == "block" for r in got if r["page_id"] is None)
    held = [bad[i] for i in blocked if i >= 2000]
    assert sum(held) / len(held) > 5 * sum(bad[i] for i in range(2000, 3000) if i % 4) / 750
    for r in got:  # host and path by plain string work
        u = dict(rows).get(r["page_id"])
        if u:
            rest = u.split("://", 1)[1]
            host = rest.split("/")[0]
            assert (r["host"], r["path"]) == (host, rest[len(host) :].split("?")[0])


def test_language(spark, odd):
    got = language.op9_language_ppm(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert got.where("score < 0 OR score > 1").count() == 0
    model = language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    found = {r["doc_id"]: r for r in language.identify(odd[0], model).collect()}
    assert found[1]["language"]["lang_pred"] == found[2]["language"]["lang_pred"] == found[3]["language"]["lang_pred"] == "und" and found[6]["language"]["lang_pred"] != "und"
    bare = language.fit(odd[0].withColumn("lang", F.lit(None).cast("string")))
    assert {r["language"]["lang_pred"] for r in language.identify(odd[0], bare).collect()} == {"und"}


def test_language_scores_and_odd_tables(spark):
    rows = [(i, f"the {prose(20)} and of", "en") for i in range(30)] + [(30 + i, f"der {prose(20)} und ist", "de") for i in range(30)]
    docs = spark.createDataFrame([*rows, (90, None, "en"), (91, "1234 ++", "de"), (92, "the and of " * 20000, None), (93, "e", None)], "doc_id bigint, text string, lang string").withColumn("language", F.lit("x"))
    model = language.fit(docs)
    found = language.identify(docs, model)
    name = found.columns[-1]
    got = {r["doc_id"]: r[name] for r in found.collect()}
    assert name != "language" and got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and got[90]["score"] == 0.0 and got[92]["lang_pred"] == "en"
    assert 0.5 <= got[93]["score"] < min(got[i]["score"] for i in range(60)) and all(got[i]["lang_pred"] == ("en" if i < 30 else "de") for i in range(60))
    twins = spark.createDataFrame([(1, "abc abd", "x"), (2, "abc abd", "a")], "doc_id bigint, text string, lang string")
    assert {r["language"]["lang_pred"] for r in language.identify(twins, language.fit(twins)).collect()} == {"a"}  # ties: the smaller name
    assert language.identify(empty(docs), model).count() == 0 and language.fit(empty(docs)).langs == []


def test_language_models_of_many_alphabets():
    rng = np.random.default_rng(9)
    grams = {f"l{k}": [(np.unique(rng.integers(0, 256 ** (n + 1), 3000)), None) for n in range(4)] for k in range(200)}
    grams = {k: [(g, np.full(len(g), 2)) for g, _ in v] for k, v in grams.items()}
    model = language.Model(sorted(grams), grams)
    assert model.nbytes() < 200 * 4 * 3000 * 24 and model.bits(rng.integers(0, 256, 5000).astype(np.uint8), np.array([0, 5000])).shape == (1, 200)


def test_code_lengths_are_exact():
    order, texts = 2, {"a": b"abracadabra abracad", "b": b"banana bandana"}
    grams = {}
    for name, body in texts.items():
        own = [collections.Counter() for _ in range(order + 1)]
        padded = bytes(order) + body
        for i in range(order, len(padded)):
            for size in range(1, order + 2):
                own[size - 1][int.from_bytes(padded[i - size + 1 : i + 1], "big")] += 1
        grams[name] = [dict(c) for c in own]
    model = language.Model(["a", "b"], grams, order)

    def bits(name, body):
        total, padded = 0.0, bytes(order) + body
        for i in range(order, len(padded)):
            cost = 0.0
            for size in range(order, -1, -1):
                context = int.from_bytes(padded[i - size : i], "big")
                seen = {g & 255: n for g, n in grams[name][size].items() if g >> 8 == context}
                if not seen:
                    continue
                t, q = sum(seen.values()), len(seen)
                if padded[i] in seen:
                    cost += np.log2((t + q) / seen[padded[i]])
                    break
                cost += np.log2((t + q) / q)
            else:
                cost += 8
            total += cost
        return total

    body = b"abanana zz cadabra"
    got = model.bits(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]
    assert np.allclose(got, [bits("a", body), bits("b", body)], rtol=1e-4)


def test_suffix_dedup(spark, odd, small):
    docs, _, rows, _ = odd

    def got(df):
        gone = F.aggregate("removed.ranges", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
        return sorted(tuple(r) for r in df.select("doc_id", "removed.n_bytes", gone, F.size("removed.ranges"), F.sha2("removed.kept", 256)).collect())

    assert got(suffix_dedup.remove(docs)) == sorted(brute.repeats(rows))
    assert got(suffix_dedup.remove(small[0])) == sorted(brute.repeats(small[1]))
    assert suffix_dedup.remove(empty(docs)).count() == 0
    h = suffix_dedup.repeats(docs, hot=2)
    assert sorted(map(tuple, h.select("h1", F.col("ranges").cast("string")).collect())) == sorted(map(tuple, suffix_dedup.repeats(docs).select("h1", F.col("ranges").cast("string")).collect()))


def test_columns_against_counting():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, length = int(rng.integers(1, 6)), 6
        group, left, rows = np.sort(rng.integers(0, 2, n)), rng.integers(0, 4, n), []
        for a in left:
            rows.append(rng.integers(97, 99, a + rng.integers(length, 9)).astype(np.uint8))
        found = suffix_dedup.repeated_windows(group, np.concatenate(rows), np.cumsum([0, *map(len, rows)]), left, length)
        key = lambda i, w: (group[i], w - left[i], rows[i][w : w + length].tobytes())  # noqa: B023, E731
        count = collections.Counter(key(i, w) for i in range(n) for w in range(len(rows[i]) - length + 1))
        assert all(found[i, w] == (count[key(i, w)] > 1) for i in range(n) for w in range(len(rows[i]) - length + 1))


def test_pipeline(spark):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA)
        sizes.append(docs.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == before.columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 100
    text = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    kept = {r[0] for r in corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).select("doc_id").collect()}
    assert kept == {d for d, (n, c) in brute.components(text).items() if d == c or not n}

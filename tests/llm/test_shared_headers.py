"""Benchmarks whose items share a header: results as by brute force, and memory in proportion to texts."""

import random
import tracemalloc

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import decontaminate as D

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("names", [3, 1 << 19])
def test_items_with_one_header(spark, monkeypatch, names):
    monkeypatch.setattr(D, "NAMES", names)
    header = prose(20)
    items = [(i, f"{header} {prose(5 + i % 7)}") for i in range(30)] + [(100 + i, prose(4)) for i in range(5)] + [(200, header), (201, None), (None, header)]
    docs = [(i, f"{prose(30)} {header} {prose(10)}") for i in range(12)] + [(50 + i, f"{prose(9)} {items[i][1]} {items[30 + i % 5][1]} {prose(9)} {header}") for i in range(8)] + [(90, None), (91, header), (92, prose(200))]
    found = D.contamination(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, text string"), out="c")
    rows = {r["doc_id"]: r["c"] for r in found.collect()}
    want = {w[0]: w for w in brute.contamination(docs, items)}
    assert len(rows) == len(docs)
    for d, c in rows.items():
        assert (c["n_words"], sum(h["end"] - h["start"] for h in c["hits"]), len(c["items"])) == want[d][1:4]
        assert c["items"] == sorted(c["items"])
    for i in range(8):
        assert rows[50 + i]["longest"]["item"] == str(i) and rows[50 + i]["longest"]["length"] == 25 + i % 7 and rows[50 + i]["longest"]["word"] == 9
    assert rows[0]["longest"].asDict() == {"length": 20, "word": 30, "item": "0", "place": 0} and rows[90]["longest"] is None


def test_many_items_with_one_header_stay_small():
    header = prose(30)
    items = D.Items([(i, f"{header} q{i}") for i in range(20_000)], 13)
    texts = [f"{prose(20)} {header} {prose(900)}".encode() for _ in range(1000)]  # about 6 MB
    places = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes, at = D.word_hashes(np.frombuffer(b"".join(texts), np.uint8), places)
    tracemalloc.start()
    shard = D.Shard(hashes, at, items)
    position, group = shard.occurrences(items)
    longest = shard.longest_of_documents(items, position, group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(position) == 18 * 1000 and len(longest) == 1000 and set(longest.values()) == {(30, 20, "0", 0)}
    assert len(items.texts_of[items.owners[group[0]]]) == 20_000 and peak < 500e6

"""Mined url rules against every subset of tokens, and templated urls of many tokens."""

import collections
import itertools
import math
import random
import time

from pyspark.sql import functions as F

from tidemark.llm import urls


def tokens_of(url):
    host, _, path = url.split("://")[1].partition("/")
    words = lambda text, mark: {mark + w for w in text.replace(".", "/").split("/") if w and not w.isdigit()}
    return words(host, "h:") | words(path, "p:")


def rules_by_hand(rows, least=urls.MIN_ROWS, lift=urls.MIN_LIFT, errors=urls.MIN_ERRORS):
    """{(tokens, blocks): (support, confidence)} of all subsets that stay after the pruning."""
    n = len(rows)
    share = collections.Counter(bad for _, bad in rows)
    found = {}
    for size in range(1, 5):
        seen = collections.Counter()
        for tokens, bad in rows:
            for part in itertools.combinations(sorted(tokens), size):
                seen[part, bad] += 1
        for (part, bad), both in seen.items():
            total, base = both + seen[part, not bad], share[bad] / n
            conf = both / total
            if both >= least and conf >= urls.MIN_CONFIDENCE and conf >= base * lift and conf - base >= errors * math.sqrt(base * (1 - base) / total):
                found[part, bad] = (both / n, conf)
    worse = lambda part, bad: any((q, bad) in found and found[q, bad][1] >= found[part, bad][1] for k in range(1, len(part)) for q in itertools.combinations(part, k))
    return {k: v for k, v in found.items() if not worse(*k)}


def test_rules_are_those_of_all_subsets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        host = rng.choice(["spam.org", "news.com", "a.b.net"])
        words = [w for w in ("casino", "win", "free", "blog", "x") if rng.random() < 0.4]
        words += ["alpha", "beta"] * (rng.random() < 0.3)  # always together
        bad = rng.random() < 0.15 + 0.5 * ("casino" in words) * ("win" in words) + 0.3 * (host == "spam.org")
        rows.append((i, f"http://{host}/{'/'.join(words)}/{i}", bad))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows], "doc_id bigint, quality int, toxic int")
    host, path = urls.host_of("url"), urls.path_of("url")
    table = pages.select("page_id", urls.tokens_of(host, path, "url").alias("tokens"))
    mined, items = urls.mine(table, labels)
    item = {r["token"]: r["item"] for r in items.collect()}
    assert item["p:alpha"] == item["p:beta"] == "p:alpha" and item["h:a"] == item["h:b"] == item["h:net"] and item["p:win"] == "p:win"
    got = {(tuple(r["tokens"]), r["blocks"]): (r["support"], r["confidence"]) for r in mined.collect()}
    every = rules_by_hand([(tokens_of(u), b) for _, u, b in rows])
    want = {k: v for k, v in every.items() if all(item[t] == t for t in k[0])}  # one of each set that says the same
    assert got.keys() == want.keys() and len(got) >= 3
    assert all(math.isclose(a, b) for k in got for a, b in zip(got[k], want[k]))
    # each url gets the rule of largest lift among all rules, merged or not
    share = sum(b for _, _, b in rows) / len(rows)
    verdicts = {r["page_id"]: r for r in urls.judge(pages, labels, rules=()).collect()}
    for i, u, _ in rows:
        own = [(c / (share if bad else 1 - share), s, bad) for (part, bad), (s, c) in every.items() if set(part) <= tokens_of(u)]
        best = max(own, key=lambda x: x[:2]) if own else None
        assert verdicts[i]["verdict"] == ("block" if best and best[2] else "allow") and (best is None) == (verdicts[i]["lift"] is None)
        assert best is None or math.isclose(best[0], verdicts[i]["lift"])


def test_templated_urls_of_many_tokens(spark):
    words = "/".join(f"w{k}x" for k in range(28))
    rows = [(i, f"http://host.org/{words}/{i}") for i in range(30)] + [(100 + i, f"http://other.org/page{i % 7}x/{i}") for i in range(60)] + [(900, "http://z.org/w3x"), (901, None)]
    labels = [(i, 0, 1) for i in range(30)] + [(100 + i, 1, 0) for i in range(60)]
    began = time.time()
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert time.time() - began < 60
    assert all(got[i] == "block" for i in range(30)) and all(got[100 + i] == "allow" for i in range(60)) and got[900] == "block" and got[901] == "allow"


def test_items_of_no_rows(spark):
    rows = spark.createDataFrame([], "tokens array<string>")
    assert urls.together(rows).count() == 0
    one = spark.createDataFrame([(["a", "b"],), (["b", "a", "c"],), (["d"],), ([],)], "tokens array<string>")
    assert {tuple(r) for r in urls.together(one).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}

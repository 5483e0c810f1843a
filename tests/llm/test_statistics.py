"""Source divergence, whitening and token counts against brute force: the smallest tables and odd rows."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.llm import divergence, token_counts, whitening

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# ---- divergence -------------------------------------------------------------------------------


def audit(rows, least=3, ranks=200):
    """(lang, source, part, item, value, rank) from (text, lang, source), term by term."""
    counts, docs, groups = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = TERM.findall((text or "").translate(LOW))
        for w in words:
            counts[lang, source, w] += 1
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(of[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 1) // (sum(own.values()) + len(kept)) for t, n in own.items()} for s, own in of.items()}
        q = {t: 1 + 10**9 * (n + 1) // (sum(whole.values()) + len(kept)) for t, n in whole.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for a in sources:
            pairs = [(-sum(f(p[a][t], p[b][t]) for t in kept), b.encode()) for b in sources if b != a]
            terms = [(-f(p[a][t], q[t]), t.encode()) for t in kept if of[a][t] and p[a][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, a, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def odd_documents():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "é", "Ärger", "z", "delta", "漢字", "x" * 300]
    rows = [(" ".join(rng.choices(words, range(1, 10), k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "", None])) for _ in range(120)]
    rows += [(None, "en", "no text"), ("123 456", "en", "no terms"), ("alone", "one", "only"), ("", "none", "s"), ("once here", "none", "t"), (None, None, None), ("alpha " * 5000, "en", "long")]
    return rows + rows[:10]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("block", [1, 256])
def test_audit_of_odd_documents(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = odd_documents()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).withColumns({"term": F.lit("x"), "n": F.lit(1)})
    assert found(divergence.audit(docs)) == audit(rows)
    if block == 1:
        assert found(divergence.audit(docs, least=1, ranks=2)) == audit(rows, 1, 2)
        assert found(divergence.audit(docs.where("text = '-'"))) == []


def test_audit_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang", "source").collect()]
    got = found(divergence.op11_radix_divergence(spark, DATA))
    assert got == audit(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(con.execute(divergence.SQL).fetchall()) == got


@pytest.mark.parametrize("k, few", [(200, 4096), (1000, 10), (10**6, 5), (1, 0)])
def test_radix_selection(spark, k, few):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        item = "".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) + ("z" * 50 if rng.random() < 0.5 else "") + str(i)
        rows.append((f"g{rng.random() * 3:.0f}", rng.choice([0, 5, 5, 5, 7, 1 << 40, (1 << 40) + 1, 1 << 59, rng.randint(0, 1 << 50)]), item))
    by = collections.defaultdict(list)
    for g, v, t in rows:
        by[g].append((-v, t.encode()))
    want = {(g, -v, t.decode(), i + 1) for g, x in by.items() for i, (v, t) in enumerate(sorted(x)[:k])}
    top = divergence.radix_top(spark.createDataFrame(rows, "g string, v bigint, t string"), ["g"], "v", "t", k, few)
    assert {tuple(r) for r in top.collect()} == want


def test_shares_beyond_longs(spark):
    row = spark.range(1).select(divergence.share(F.lit(10**13), F.lit(3 * 10**13), F.lit(7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7)


# ---- whitening --------------------------------------------------------------------------------


def plain_whitening(rows, k=16):
    """By row: deviation and whitened values; eigenvalues' shares; from a full covariance matrix."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), object)
    n, s = len(x), x.sum(axis=0)
    y = (x * n - s).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, len(e))
    each = [(i, sum(int(c) ** 2 for c in np.array(own, object) * n - s), (np.array(own, object) * n - s).astype(float) / n @ v[:, :k] / np.sqrt(e[:k])) for i, own in kept]
    return each, e[:k] / e.sum(), n


def same(out, rows, k=16):
    each, shares, n = plain_whitening(rows, k)
    got = collections.defaultdict(list)
    for r in out:
        got[r["vec_id"]].append(r)
    assert len(out) == len(each) * len(shares)
    assert {r["n"] for r in out} == {n} and max(r["identity_error"] for r in out) <= 1e-8
    for j, share in enumerate(shares):
        pairs = []
        for i, deviation, z in each:
            own = [r for r in got[i] if r["component"] == j + 1]
            assert own and all(r["deviation"] == deviation and math.isclose(r["explained"], share, rel_tol=1e-9) for r in own)
            pairs.append((z[j], own[0]["whitened"]))
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(whitening.op12_block_lanczos(spark, DATA).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((60, 6)) * [9, 5, 4, 3, 2, 1])]
    rows += [(100, rows[0][1]), (0, rows[0][1]), (101, [c + 1e-9 if c > 0 else c for c in rows[3][1]])]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] + [0.0] * 5), (203, [math.inf] + [0.0] * 5)]
    drop = [(204, []), (205, [1.0, 2.0]), (206, [1e300] + [0.0] * 5)]  # of another length, or beyond longs
    schema = "vec_id bigint, embedding array<double>"
    df = spark.createDataFrame(rows + odd + drop, schema).withColumns({"component": F.lit(1), "key": F.lit("k"), "x": F.lit(0)}).repartition(3)
    same(whitening.whiten(df).collect(), rows + odd)
    assert whitening.whiten(df.where("vec_id < 0")).count() == 0
    assert whitening.whiten(df.where("vec_id IN (0, 100)")).count() == 0  # nothing varies
    assert whitening.whiten(df.where("vec_id = 204")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}  # the others' eigenvalues are 0
    huge = spark.createDataFrame([(i, [float(i) * 1e14, float(-i * i)]) for i in range(5)], schema)
    out = whitening.whiten(huge).collect()
    assert len(out) >= 5 and any(r["deviation"] is None for r in out) and max(r["identity_error"] for r in out) < 1e-4


@pytest.mark.parametrize("d, most, kind", [(300, 90, "long"), (64, 1024, "long"), (40, 1024, "flat"), (3, 1024, "long"), (120, 60, "many")])
def test_lanczos(d, most, kind):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"long": np.linspace(8, 1, d) ** 3, "flat": np.repeat([2.0, 0.0], [30, 10])[:d], "many": np.concatenate([np.full(14, 9.0), np.linspace(8, 1, d - 14)])[:d] if d > 14 else None}[kind]
    a = q * e @ q.T
    values, vectors = whitening.lanczos(lambda block: a @ block, d, 16, most=most)
    assert np.allclose(values, e[:16], rtol=1e-10, atol=1e-10 * e[0]) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-9 * e[0]


# ---- token counts -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


@pytest.mark.parametrize("most", [10, 1 << 14])
def test_token_counts_of_odd_texts(spark, library, monkeypatch, most):
    monkeypatch.setattr(token_counts, "CACHED", 50)  # generations turn over
    monkeypatch.setattr(token_counts, "FAN", 2)  # packed rows are merged in rounds
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\r\n", "▁", "a", "foo", "The", "é", "漢字", "😀", "<s>", "123", ".", ";\r", " ", "　", "}", " {", "\x00", "ﬁ", "ing", "▁▁", "<0x0A>", "a-word-of-over-sixteen-bytes"]
    texts = [None, "", " ", "\n", " \n", "a\n", "▁", "x" * 5000, "ab " * 9000, "a" * 70 + " b", "foo", "foo"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"n_tokens": F.lit("kept"), "raw_text": F.lit(1)}).repartition(6)
    out = token_counts.count_tokens(docs, most=most, limit=40)
    assert out.columns == ["doc_id", "text", "n_tokens", "raw_text", "n_bytes", "n_tokens_", "over_limit"]
    rows = out.collect()
    assert len(rows) == len(texts) and all(r["n_tokens"] == "kept" for r in rows)
    for r in rows:
        n = len(library.encode(r["text"] or ""))
        assert (r["n_bytes"], r["n_tokens_"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 40), r["text"]
    assert token_counts.count_tokens(docs.where("doc_id < 0")).count() == 0


def test_token_counts_of_the_table(spark, library):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = token_counts.op13_two_tier_tokens(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]] or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 4096)


def test_frequent_table_holds_the_commonest(spark):
    docs = spark.createDataFrame([("the cat the dog the end",)] * 50 + [("rare word",)], "text string").repartition(4)
    words = token_counts.frequent(docs, most=3)
    assert words[0] == b" the" and len(words) == 3 and b" rare" not in words
    table = token_counts.Lengths(words, [1, 2, 3])
    data = np.frombuffer(b"".join(words) + b" rare", np.uint8)
    ends = np.cumsum([*map(len, words), 5])
    assert table.find(*token_counts.keys(data, np.concatenate([[0], ends[:-1]]), ends)).tolist() == [1, 2, 3, 0]

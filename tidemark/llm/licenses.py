"""License scans by patience alignment of documents with license templates.

Words that occur once in the template and once in the stretch of text at hand are anchors; the longest
run of anchors in the order of both texts stays, and the gaps between them are aligned in the same
way, equal words at both ends of a gap first.  A template's coverage is the part of its words that is
aligned.  Stretches of a document are looked at around as many of its rarest words of the template as
no match at the coverage can do without, so a license that a text holds twice is found, and so is an
edited one whose rarest word stands elsewhere.

A template can only be covered if enough of its words occur at all; that exact test spares most
alignments.  Documents are read whole, one by one, without a shuffle.

Rows: null and empty texts have no words and no license; repeated rows are judged alike; templates
without words never match.  Of equal coverages the longer template, then the smaller name wins.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")
#: License notices (fixed values, as published).
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT line": "Released under the MIT License.",
}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of ``a`` and ``b``, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if once_b[w] == 1}
        both = [(p, place[w]) for p, w in enumerate(a[i:j], i) if once_a[w] == 1 and w in place]
        kept = [both[p] for p in rising([y for _, y in both])]
        if not kept:
            continue
        edges = [(i - 1, k - 1), *kept, (j, m)]
        out += kept
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(out)


def best_match(template: list[str], text: list[str], where: dict[str, list[int]], coverage: float = COVERAGE) -> tuple[float, int, int]:
    """(coverage, first word, end) of the best stretch of the text.

    A match leaves out (1 - coverage) of the template's places at most, so it holds one of any words
    that stand at more places than that: the rarest such words are looked around."""
    count, spare = Counter(template), len(template) - ceil(coverage * len(template) - 1e-9)
    rare, places = [], set()
    for w in sorted(count, key=lambda w: (len(where.get(w, ())), w)):
        rare.append(w)
        places.update(where.get(w, ()))
        spare -= count[w]
        if spare < 0:
            break
    best = (0.0, 0, 0)
    reach, stretches, spots = 2 * len(template), [], sorted(places)
    for p in spots:
        if stretches and p - reach <= stretches[-1][1]:
            stretches[-1][1] = p + reach
        else:
            stretches.append([max(0, p - reach), p + reach])
    for a, b in stretches:
        # stretches that overlap were joined; each part around one place of a rare word is tried too
        parts = [(p - reach // 2, p + reach // 2) for p in spots[bisect_left(spots, a) : bisect_left(spots, b)]] if b - a > 2 * reach else []
        for x, y in [(a, b), *parts]:
            x = max(0, x)
            own = text[x:y]
            # no alignment covers more than the words in common
            if sum((count & Counter(own)).values()) < max(coverage, best[0]) * len(template):
                continue
            pairs = align(template, own)
            if pairs and len(pairs) / len(template) > best[0]:
                best = (len(pairs) / len(template), x + pairs[0][1], x + pairs[-1][1] + 1)
    return best


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("licenses", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, out: str = "scan") -> DataFrame:
    """``docs`` with a struct appended (last column): n_words, and licenses by falling coverage."""
    name = C.fresh(out, docs.columns)
    known = [(k, words(v), Counter(words(v))) for k, v in templates.items() if words(v)]
    kind = pa.struct([("n_words", pa.int64()), ("licenses", pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])))])
    vocabulary = {w for _, t, _ in known for w in t}

    def work(batches):
        for batch in batches:
            for piece in C.pieces(batch, text, 4 << 20):
                rows = []
                for body in piece.column(text).to_pylist():
                    own, found = words(body), []
                    where: dict[str, list[int]] = {}
                    if not vocabulary.isdisjoint(own):
                        for p, w in enumerate(own):
                            if w in vocabulary:
                                where.setdefault(w, []).append(p)
                    for k, template, count in known:
                        if sum(min(n, len(where[w])) for w, n in count.items() if w in where) >= coverage * len(template):
                            part, a, b = best_match(template, own, where, coverage)
                            if part >= coverage:
                                found.append((-part, -len(template), k, a, b))
                    rows.append({"n_words": len(own), "licenses": [{"name": k, "coverage": -part, "start": a, "end": b} for part, _, k, a, b in sorted(found)]})
                yield C.with_column(piece, name, pa.array(rows, kind))

    return C.mapped(docs, work, T.StructType([*docs.schema.fields, T.StructField(name, FOUND)]))


def op6_patience_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    top = F.try_element_at("scan.licenses", F.lit(1))
    return scan(docs).select("doc_id", "scan.n_words", F.size("scan.licenses").cast("bigint").alias("n_licenses"), top["name"].alias("license"), top["coverage"].alias("coverage"), top["start"].alias("start"), top["end"].alias("end"))

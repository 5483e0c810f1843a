"""Plain restatements of the contracts, for small inputs."""

import collections
import hashlib
import re

ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    sets = {d: shingles(t) for d, t in docs}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeats(docs, length=400):
    body = [(d, (t or "").encode()) for d, t in docs]
    count = collections.Counter(b[p : p + length] for _, b in body for p in range(len(b) - length + 1))
    out = []
    for d, b in body:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out

"""Plain versions of the operators, a row at a time."""

import hashlib
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return (text or "").encode().split()


def statistics(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    seen, copies = set(), 0
    for x in lines:
        copies += x in seen
        seen.add(x)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), copies, len(covered)


def fingerprint(text, k=3):
    w = [x.lower() for x in words(text)]
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def components(rows, k=3, bits=3):
    """(fingerprint, component) of each (doc_id, text) row."""
    fps = [fingerprint(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and find(i) != find(j):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return [(f, least[find(i)]) for i, f in enumerate(fps)]


def removed(rows, window=13):
    """For each (doc_id, text) row, the set of word places that go."""
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, float("inf")), key(d))
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone |= set(range(i, i + window))
        out.append(gone)
    return out


def without(text, gone):
    """The text without some of its words, each with the white space after it."""
    import re

    if not gone:
        return text or ""
    space = rb"[\x20\x09-\x0D]"
    raw = (text or "").encode()
    lead = re.match(space + b"*", raw)[0]
    parts = re.findall(rb"[^\x20\x09-\x0D]+" + space + b"*", raw)
    return (lead + b"".join(p for i, p in enumerate(parts) if i not in gone)).decode()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def nearest(vectors, k=5):
    """{query: [(vec_id, score)...]} of all usable vectors; vectors: {vec_id: list}."""
    ids = sorted(i for i, v in vectors.items() if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for i, q in zip(ids, x):
        s = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(ids[j], s[j]) for j in order]
    return out


def shingle_set(text, k=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def alike(rows):
    """The component of each (doc_id, text) row, from the exact five-word Jaccard similarity of all pairs: 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and find(i) != find(j):
                label[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return [least[find(i)] for i in range(len(rows))]

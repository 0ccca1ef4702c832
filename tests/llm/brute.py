"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter

import numpy as np


def word_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near(ids, texts, percent):
    s = word_sets(texts)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    return components(ids, links), dict(zip(ids, map(len, s), strict=True))


def repeats(rows, width=100):
    """rows: (id, text), each id once. {id: (n_bytes, n_removed, n_spans, sha256, kept bytes)}"""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = [False] * len(b)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                cover[p : p + width] = [True] * width
            seen.add(w)
        kept = bytes(c for c, m in zip(b, cover, strict=True) if not m)
        out[i] = (len(b), sum(cover), sum(m and not (k and cover[k - 1]) for k, m in enumerate(cover)), hashlib.sha256(kept).hexdigest(), kept)
    return out


def hits(text, items, width=13):
    """(words, hit words, sorted ids of items that occur)"""
    cut = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    w, cover, found = cut(text), set(), set()
    for i, t in items:
        own = cut(t)
        k = min(width, len(own))
        for p in range(len(own) - k + 1 if k else 0):
            for q in range(len(w) - k + 1):
                if w[q : q + k] == own[p : p + k]:
                    cover |= set(range(q, q + k))
                    found.add(str(i))
    return len(w), len(cover), sorted(found)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def base_scores(texts, train):
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    c = Counter(x for t, y in zip(tokens, train, strict=True) if y for x in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for t in tokens]

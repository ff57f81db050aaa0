"""Plain brute-force versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(docs, n, num, den):
    sets = {i: shingles(t, n) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    groups = closure(sets, links)
    return {i: (len(sets[i]), groups[i]) for i in sets}


def contamination(docs, items, width):
    windows = {}
    for item, text in items:
        w = alnum(text)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w, hit, names = alnum(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= own
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out


def bigrams(docs, train, mu):
    """(n_tokens, n_known, N, base, score) by plain dictionaries."""
    single, pair = Counter(), Counter()
    for i, t in docs:
        if train(i):
            w = [*words(t), "</end of text>"]
            single.update(w)
            pair.update(zip([w[-1], *w], w))
    n, v = sum(single.values()), len(single)
    out = {}
    for i, t in docs:
        w = [*words(t), "</end of text>"]
        p = [(single[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        score = sum(math.log10((pair[a, b] + mu * q) / (single[a] + mu)) for a, b, q in zip([w[-1], *w], w, p))
        out[i] = (len(w), sum(single[x] > 0 for x in w), n, sum(map(math.log10, p)), score)
    return out


def crc(value):
    return zlib.crc32(str(value).encode())

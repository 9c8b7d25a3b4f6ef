"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return t.translate({i: i + 32 for i in range(65, 91)})


def components(ids, links) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def base_rules(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside.update(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def shingles(text, k):
    words = WORD.findall(lower(text or ""))
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def near(docs, k, percent=80):
    sets = {i: shingles(t, k) for i, t in docs}
    links = []
    for (a, s), (b, t) in itertools.combinations(sets.items(), 2):
        n = len(s & t)
        if n and 100 * n >= percent * (len(s) + len(t) - n):
            links.append((a, b))
    found = components(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def contamination(docs, items, width=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict = {}
    for i, t in items:
        w = word.findall(lower(t or ""))
        n = min(width, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, own = word.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    own |= x
        digest = hashlib.sha256(",".join(sorted(str(i) for i in own if i is not None)).encode()).hexdigest()
        out[d] = len(w), len(hit), len([i for i in own if i is not None]), digest, len(hit) > 0 and 20 * len(hit) >= len(w)
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]

"""Small brute-force helpers that the tests hold the operators against."""

import re
from collections import defaultdict


def roots(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def near(rows, size, percent):
    """doc_id -> (set size, component, kept) from (doc_id, text)."""
    sets = {d: shingles(t, size) for d, t in rows}
    holders = defaultdict(list)
    for d, found in sets.items():
        for x in found:
            holders[x].append(d)
    common = defaultdict(int)
    for ids in holders.values():
        ids.sort()
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    top = roots(sets, links)
    return {d: (len(sets[d]), top[d], top[d] == d) for d in sets}

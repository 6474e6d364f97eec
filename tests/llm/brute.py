"""Plain versions of the operators' results, for comparison."""

import re
from collections import Counter, defaultdict


class Links:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def jaccard_components(rows, n, percent):
    """rows: (doc_id, text). {doc_id: component}, exactly, by prefix filtering with rare shingles first."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[shingles(t, n)].append(i)
    links = Links()
    for x, ids in groups.items():
        for i in ids:
            links.find(i)
            if x:
                links.join(ids[0], i)
    sets = sorted((x for x in groups if x), key=len)
    often = Counter(s for x in sets for s in x)
    index = defaultdict(list)
    for k, x in enumerate(sets):
        need = -(-percent * len(x) // 100)
        prefix = sorted(x, key=lambda s: (often[s], s))[: len(x) - need + 1]
        seen = {j for s in prefix for j in index[s] if 100 * len(sets[j]) >= percent * len(x)}
        for j in seen:
            common = len(x & sets[j])
            if 100 * common >= percent * (len(x) + len(sets[j]) - common):
                links.join(groups[x][0], groups[sets[j]][0])
        for s in prefix:
            index[s].append(k)
    return {i: links.find(i) for i, _ in rows}

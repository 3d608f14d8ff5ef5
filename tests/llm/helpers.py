"""Plain versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile("[A-Z]")


def words(text):
    return WORD.findall(UPPER.sub(lambda m: m.group().lower(), text or ""))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


class Sets:
    """Disjoint sets whose name is their smallest member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(docs, percent):
    """{doc_id: (size, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    groups = Sets(sets)
    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.top(i)) for i in sets}

"""Plain versions of what the operators compute."""
from collections import Counter, defaultdict


def words(text):
    return text.encode().lower().split()


def components_of(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            lists[x].add(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in lists[x] if j < i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

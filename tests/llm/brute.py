"""Plain Python versions of the operators' results, for small tables."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, width):
    words = tuple(WORD.findall(lower(text or "")))
    if len(words) < width:
        return {words} if words else set()
    return {words[i : i + width] for i in range(len(words) - width + 1)}


def union_find(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(rows, width, percent=80):
    """rows: (id, text); {id: (n_shingles, component)}"""
    sets = {i: shingle_set(t, width) for i, t in rows}
    holds = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holds[x].append(i)
    both = defaultdict(int)
    for ids in holds.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = union_find(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}

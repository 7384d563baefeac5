"""Plain Python answers to compare the operators with."""

from __future__ import annotations

import re
from collections import defaultdict


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(docs):
    """docs: id -> text. Id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                shared[a, b] += 1
    edges = [
        (a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)
    ]
    named = roots(docs, edges)
    return {i: (len(sets[i]), named[i]) for i in docs}


def within(a, b, k):
    """At most k insertions, deletions and substitutions apart."""
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i] + [k + 1] * len(b)
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != b[j - 1]))
        if min(row) > k:
            return False
    return row[-1] <= k


def line_classes(docs, k=1):
    """docs: id -> text. Id -> (lines, links, matched lines, class documents, repeats)."""
    at = defaultdict(list)
    for d, text in sorted(docs.items()):
        for i, line in enumerate((text or "").split("\n")):
            if len(line) >= 20 and re.search(r"[^\x20\x09-\x0D]", line):
                at[line].append((d, i))
    by_length = defaultdict(list)
    for line in at:
        by_length[len(line)].append(line)
    links = set()
    for n, group in by_length.items():
        rest = [b for more in range(1, k + 1) for b in by_length.get(n + more, [])]
        for x, a in enumerate(group):
            links |= {(a, b) for b in group[x + 1 :] + rest if within(a, b, k)}
    named = roots(at, links)
    first, degree = {}, defaultdict(int)
    for line, places in at.items():
        first[named[line]] = min(first.get(named[line], places[0]), places[0])
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    out = {}
    for d, text in docs.items():
        lines = (text or "").split("\n")
        match = [i for i, x in enumerate(lines) if x in at and (len(at[x]) > 1 or degree[x])]
        begins = [first[named[lines[i]]] for i in match]
        out[d] = (
            len(lines), sum(degree[lines[i]] for i in match), match, [b[0] for b in begins],
            [i for i, b in zip(match, begins) if b != (d, i)],
        )
    return out

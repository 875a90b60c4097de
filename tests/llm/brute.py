"""Plain reference versions, for small inputs."""

from __future__ import annotations

import re


def spaced_words(text: str | None) -> list[bytes]:
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text: str | None, width: int) -> set:
    words = spaced_words(text)
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def roots(nodes, links) -> dict:
    """Node to the smallest node of its component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(rows: list[tuple], width: int, percent: int) -> dict:
    """doc_id -> (set size, component) by comparing all pairs that share an n-gram; ids are distinct."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    holders: dict = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    links, tried = [], set()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        links.append((a, b))
    found = roots(list(sets), links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def letter_words(text: str | None) -> list[bytes]:
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def passages(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """(doc_id, words, hit words, items that occur) of every document, by looking each window up."""
    owners: dict = {}
    for item, text in items:
        w = letter_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[i:i + window]), set()).add(item)
    lengths = {len(k) for k in owners}
    out = []
    for doc, text in docs:
        w, hit, found = letter_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := owners.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return out

"""Brute-force versions that several tests share."""

import itertools
import re

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def roots(n, links):
    up = list(range(n))
    while True:
        before = list(up)
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
        if up == before:
            return up


def word_shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def line_components(rows):
    """Of rows (id, text) in order: the places of the lines that go."""
    places = [(i, k, x.lower().strip()) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = [{x[j : j + 8] for j in range(max(1, len(x) - 7))} for _, _, x in places]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {places[k][:2] for k, c in enumerate(roots(len(sets), links)) if c != k}


def contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    d, hit, found = words(text), set(), set()
    for item_id, t in items:
        w = words(t)
        for win in [w[i : i + 13] for i in range(max(1, len(w) - 12))] if w else []:
            for i in range(len(d) - len(win) + 1):
                if d[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item_id))
    return len(d), len(hit), sorted(found)

import random

import pytest

from driftlog.llm import near_dedup as N
from driftlog.llm.common import ascii_lower_words

from .conftest import EDGES, prose


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = ascii_lower_words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * len(a | b):
                root[find(i)] = find(j)
    comp = {}
    for i in range(len(rows)):
        comp.setdefault(find(i), []).append(i)
    out = []
    for i in range(len(rows)):
        ids = [rows[k][0] for k in comp[find(i)] if rows[k][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None)))
    return out


def edited(text, share, seed):
    rng, words = random.Random(seed), text.split()
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


def family(base, first, n, share):
    return [(first + k, edited(prose(base, 300), share, first + k)) for k in range(n)]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(make_docs, monkeypatch, width, percent):
    rows = EDGES + family(50, 1000, 40, 0.004) + family(51, 2000, 40, 0.015) + family(52, 3000, 40, 0.03) + [(4000 + k, prose(200 + k, 120)) for k in range(60)]
    rows += [(5000 + k, t.upper()) for k, (_, t) in enumerate(rows[20:30])]
    got = N.near_dedup(make_docs(rows), width, percent).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, width, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_regions_are_dealt_out_without_loss(make_docs, monkeypatch):
    monkeypatch.setattr(N, "REGION", 10)
    monkeypatch.setattr(N, "SIDE", 8)
    rows = family(60, 0, 80, 0.01) + family(61, 100, 80, 0.02)
    got = N.near_dedup(make_docs(rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_empty_table(make_docs):
    assert N.near_dedup(make_docs([])).count() == 0

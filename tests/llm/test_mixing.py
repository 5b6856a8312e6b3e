import hashlib
import re
from collections import defaultdict

import pytest

from driftlog.llm.mixing import mix

from .conftest import EDGES, prose


def water(sizes, weights, share, cap):
    """Shares by weight, the excess over caps reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(rows, got, weights=(3, 1, 2), share=1.5, cap=2.0):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    want = water(dict(sizes), weights, share, cap)
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(size(r[1]) for r in rows)
    of = {r[0]: r[2] for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= cap * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


def docs(n):
    return [(i, prose(i, 1 + i * 7 % 50), [None, "a", "b", "b", "b", "b", "c", "ä", "Z"][i % 9]) for i in range(n)]


def test_targets_and_sums(make_docs):
    rows = docs(900)
    got = mix(make_docs(rows)).collect()
    check(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(make_docs(rows).repartition(7)).collect()))


@pytest.mark.parametrize("weights,share,cap", [((1,), 0.5, 2.0), ((5, 1), 1.0, 1.0), ((3, 1, 2), 1.9, 2.0), ((3, 1, 2), 0.0, 2.0)])
def test_other_budgets(make_docs, weights, share, cap):
    rows = docs(300)
    check(rows, mix(make_docs(rows), weights, share, cap).collect(), weights, share, cap)


def test_larger_budgets_only_add(make_docs):
    df = make_docs([r for r in docs(400) if r[2] == "b"])
    less, more = ({r.doc_id: r.taken for r in mix(df, share=s).collect()} for s in (0.3, 0.6))
    assert all(more[i] >= t for i, t in less.items())


def test_edges(make_docs):
    rows = [(i, t, "s") for i, t in EDGES]
    got = mix(make_docs(rows), carry=("text", "kept")).collect()
    assert len(got) == len(EDGES) and all(r.taken <= 2 * r.size for r in got)
    assert {hashlib.md5((r.text or "").encode()).digest() for r in got} == {hashlib.md5((t or "").encode()).digest() for _, t in EDGES}
    assert mix(make_docs([])).count() == 0
    assert [tuple(r) for r in mix(make_docs([(1, None, None), (2, "", "a")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]

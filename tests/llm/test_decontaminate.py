import random

import numpy as np
import pytest

from driftlog.llm import decontaminate as D

from .conftest import EDGES, prose


def plain_align(item, doc):
    h = np.zeros((len(item) + 1, len(doc) + 1), int)
    for i in range(len(item)):
        for j in range(len(doc)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if item[i] == doc[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64)
        assert D.align(a, b)[0] == plain_align(a, b)


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"zz{rng.randrange(999)}" for w in text.split())


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, prose(700 + k, 40)) for k in range(20)] + [(50, None), (51, ""), (52, "short qqq item"), (53, prose(700, 40))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_copies_are_found_and_clean_documents_left(make_docs, items, monkeypatch):
    rows = list(EDGES) + [(100 + k, prose(3000 + k, 200)) for k in range(40)]
    rows += [(200 + k, prose(4000 + k, 90) + " " + changed(prose(700 + k, 40), share, k) + " " + prose(5000 + k, 90)) for share in (0.0, 0.1, 0.2) for k in range(5, 15)]
    rows += [(300, "Before. SHORT, Qqq item!"), (301, prose(701, 40).upper())] + [(400 + k, prose(703, 40)) for k in range(60)]
    rows.append((201, prose(707, 40)))
    for block in (20_000, 5):
        monkeypatch.setattr(D, "ITEMS", block)
        got = D.contaminated(make_docs(rows), items).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        want = {(200 + k, k) for k in range(5, 15)} | {(300, 52), (301, 1), (201, 7)} | {(400 + k, 3) for k in range(60)}
        assert pairs == want
    assert {r.score for r in got if r.doc_id >= 400} == {1.0}


def test_a_part_that_many_quote_is_found(make_docs, items):
    words = prose(702, 40).split()
    edited = [*words[:9], "edit", *words[10:19]]
    rows = [(100 + k, prose(3000 + k, 50) + " " + " ".join(words[:21])) for k in range(40)] + [(200, " ".join(edited))]
    got = {(r.doc_id, r.item_id, r.score >= 0.4) for r in D.contaminated(make_docs(rows), items).collect()}
    assert got == {(i, 2, True) for i, _ in rows}


def test_places_are_spread():
    rng = np.random.default_rng(2)
    for _ in range(200):
        held, chosen = rng.integers(0, 5, rng.integers(1, 60)), rng.random(1)[0] * 0.3
        chosen, size = rng.random(len(held)) < chosen, int(rng.integers(1, 9))
        got = D.spread(held, chosen, size)
        assert (got | chosen).tolist() == got.tolist() and all(got[i : i + size].any() for i in range(len(held) - size + 1))


def test_an_item_twice_is_found_twice(make_docs, items):
    assert {r.item_id for r in D.contaminated(make_docs([(1, prose(700, 40))]), items).collect()} == {0, 53}


def test_empty_sides(make_docs, items):
    assert D.contaminated(make_docs([]), items).count() == 0
    assert D.contaminated(make_docs(EDGES), items.limit(0)).count() == 0
    assert D.contaminated(make_docs(EDGES), items.where("item_id in (50, 51)")).count() == 0


def test_every_item_against_every_document(spark):
    """All pairs of sf0.001 by the alignment alone."""
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    words = D._Words()
    given = {r.item_id: words(r.text) for r in items.collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        w = words(r.text)
        for i, item in given.items():
            if len(np.intersect1d(item, w)) >= D.LEAST * len(np.unique(item)) / 2 and len(item) and D.align(item, w)[0] >= D.LEAST * len(item):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert got == want and len(want) >= 3

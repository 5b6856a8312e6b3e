import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftlog.llm import language_model as M
from driftlog.llm.common import ascii_lower_words
from driftlog.llm.elias_fano import EliasFano

from .conftest import EDGES, prose


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 10), (1000, 1 << 40), (1000, 1200), (70_000, 1 << 20), (3000, 3000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    e = EliasFano.of(EliasFano.build(v, top).arrays("x"), "x")
    assert (e.access(np.arange(n)) == v).all()
    q = rng.integers(0, top, 500).astype(np.uint64)
    at, found = e.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()


def test_counts_survive_packing():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 60, 1000)).astype(np.uint64)
    counts = rng.integers(1, 1 << 40, len(keys))
    a, b = M._unpack(M._pack(keys, counts))
    assert (a == keys).all() and (b == counts).all()


def brute(rows, least=1):
    """Scores from dictionaries, without quantisation."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tok = [ascii_lower_words(t) + ["\n"] for _, t in rows]
    c = {n: Counter() for n in (1, 2, 3)}
    for (i, _), w in zip(rows, tok, strict=True):
        if not held(i):
            for n in c:
                c[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    c[3] = Counter({k: v for k, v in c[3].items() if v >= least})
    total, size = sum(c[1].values()), len(c[1])
    after = {n: defaultdict(lambda: [0, 0]) for n in (2, 3)}
    for n in after:
        for k, v in c[n].items():
            after[n][k[:-1]][0] += 1
            after[n][k[:-1]][1] += v

    def p(h, w):
        out = (c[1][w,] + 1) / (total + size + 1)
        for n in (2, 3):
            ctx = tuple(h[len(h) - n + 1 :]) if len(h) >= n - 1 else None
            if ctx and ctx in after[n]:
                t, s = after[n][ctx]
                whole = c[n - 1][ctx] + t
                out = c[n][(*ctx, w)] / whole + (1 - s / whole) * out
        return out

    out = []
    for (i, _), w in zip(rows, tok, strict=True):
        base = sum(math.log10((c[1][x,] + 1) / (total + size + 1)) for x in w)
        out.append((i, held(i), len(w), sum((x,) in c[1] for x in w), total, base, sum(math.log10(p(w[max(0, k - 2) : k], w[k])) for k in range(len(w)))))
    return out


@pytest.mark.parametrize("piece,least", [(M.PIECE_BYTES, 1), (3000, 1), (3000, 2)])
def test_scores_equal_brute_force_but_for_quantisation(make_docs, monkeypatch, piece, least):
    monkeypatch.setattr(M, "PIECE_BYTES", piece)
    rows = EDGES[:-2] + [(100 + k, " ".join(f"{w} the of" for w in prose(k % 17, 60).split())) for k in range(60)]
    got = M.lm_scores(make_docs(rows), keep={2: 1, 3: least}).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows, least), key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and abs(g[6] - w[6]) <= 0.06 * w[2]


def test_unseen_words_are_likelier_than_nothing_and_repeats_than_noise(make_docs):
    rows = [(k, "the river stone the river stone the river") for k in range(40)]
    held = [k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    got = {r.doc_id: r for r in M.lm_scores(make_docs([*rows, (held[0], "the river stone"), (held[1], "stone the zebra")])).collect()}
    assert got[held[0]].held_out and got[held[1]].n_known == 3
    assert 0 > got[held[0]].score > got[held[1]].score > -50


def test_trigrams_that_occur_once_are_kept(make_docs):
    learned = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2)
    one = 2 / 9  # four tokens of four kinds
    two = 1 / 2 + one / 2
    three = 1 / 2 + two / 2
    got = M.lm_scores(make_docs([(learned, "a b c")])).first()
    assert got.score == pytest.approx(sum(map(math.log10, (one, two, three, three))), abs=0.1)


def test_words_of_long_texts_are_hashed_part_by_part():
    from driftlog.llm.common import hashed_words, word_hashes

    texts = [b"", prose(1, 500).encode(), b"x" * 5000, b" \n ", prose(2, 3).encode() + b"\x85\xff end"]
    want, count = word_hashes(texts)
    for limit in (1, 50, 1 << 20):
        got, n = hashed_words(texts, limit)
        assert got.tolist() == want.tolist() and n.tolist() == count.tolist()


def test_empty_tables(make_docs):
    assert M.lm_scores(make_docs([])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = M.lm_scores(make_docs([(held, "a b")])).first()
    assert only.train_tokens == 0 and only.n_known == 0 and only.score == pytest.approx(0)
    assert M.lm_scores(make_docs([(1, None)])).first().n_tokens == 1

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftlog.llm import token_counts as T

from .conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PIECES = ["'", "'s", "'re", "'ll", "'v", "r", " ", "  ", "\n", "\t", "a", "1", "é", "日", "!", "--", "<|endoftext|>", "the", " ", "'T", " ", "e", "🙂", "=", "x" * 9, "՘", "꟎", "​", "́"]


def library(texts):
    return [len(e.ids) for e in LIB.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_equals_the_library_on_mixed_pieces():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "=" * 4000, " " * 900, "ab" * 500]
    assert T.count_tokens(texts, PATH).tolist() == library(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(text):
    assert T.count_tokens([text], PATH).tolist() == library([text])


def test_a_full_table_changes_nothing(monkeypatch):
    small = T.TokenTransducer(PATH, most=100)
    monkeypatch.setattr(T, "transducer", lambda path: small)
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(30)) for _ in range(500)]
    assert T.count_tokens(texts, PATH).tolist() == library(texts)


def test_prefix_scan_composes_maps():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 12, (12, 37)).astype(np.uint8)
    got, now = T.scan(maps), np.arange(12)
    for i in range(37):
        now = maps[now, i]
        assert (got[:, i] == now).all()


@pytest.mark.parametrize("chunk", [1, 3, 64, 1000])
def test_chunks_of_any_size_split_alike(chunk):
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 12, 700).astype(np.uint8)
    assert (T.pretoken_starts(kinds, chunk) == T.pretoken_starts(kinds, 256)).all()


def test_rows(make_docs):
    got = T.token_counts(make_docs(EDGES), PATH, 10).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.doc_id) == sorted((False, i, len((t or "").encode()), n, n > 10) for (i, t), n in zip(EDGES, library([t for _, t in EDGES]), strict=True) if i)
    assert len(got) == len(EDGES)
    assert T.token_counts(make_docs([]), PATH).count() == 0

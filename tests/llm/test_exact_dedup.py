import hashlib
from collections import defaultdict

import pytest

from driftlog.llm.exact_dedup import drop_exact, exact_dedup

from .conftest import EDGES, prose

MORE = [(20, prose(3, 900)), (21, prose(3, 900)), (22, prose(3, 899) + " other9"), (23, "other9 " + prose(3, 899)), (24, prose(3, 450)), (25, "ab" * 8), (26, "ab" * 16), (27, "ab" * 8)]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_groups(make_docs, block):
    rows = EDGES + MORE
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_dedup(make_docs(rows), block).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        text = by_sha[r.text_sha256]
        ids = [i for i in groups[text] if i is not None]
        assert r.group_size == len(groups[text]) and r.keep_id == max(ids, default=None) and r.doc_id in groups[text]
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_drop_keeps_rows_as_they_are(make_docs):
    df = make_docs(EDGES + MORE)
    got = drop_exact(df)
    assert got.columns == df.columns
    assert sorted((r.text or "") for r in got.collect()) == sorted({t or "" for _, t in EDGES + MORE})
    assert drop_exact(make_docs([])).count() == 0 and exact_dedup(make_docs([])).count() == 0


def test_very_frequent_blocks_are_named_alike(make_docs):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(50)]
    got = exact_dedup(make_docs(rows), 4)
    assert got.where("kept").count() == 51
    assert got.where("group_size = 3000 and keep_id = 2999").count() == 3000


def test_rows_keep_columns_of_any_name(spark):
    from driftlog.llm.common import marked, without
    from driftlog.llm.exact_dedup import drop_exact

    rows = [(1, "a", "x", 1, True, 0, 9), (2, "a", "y", 2, False, 0, 8), (3, "b", "z", 3, None, 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_sha string, stays int, kept boolean, fate_id int, mark int")
    assert sorted(map(tuple, drop_exact(docs).collect())) == rows[1:] and drop_exact(docs).columns == docs.columns
    gone = marked(docs.select("doc_id", "text")).where("doc_id = 3").select("mark")
    assert sorted(map(tuple, without(docs, gone).collect())) == rows[:2] and without(docs, gone).columns == docs.columns

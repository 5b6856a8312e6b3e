import pytest
from pyspark.sql import Row

import corpus_pipeline as P
from driftlog.llm.decontaminate import contaminated
from driftlog.llm.near_dedup import near_dedup
from driftlog.llm.quality import quality_scores

from .conftest import EDGES, prose
from .test_near_dedup import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again as the next one's documents."""
    at, out = tmp_path_factory.mktemp("stages"), {}
    docs = out["documents"] = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in P.STAGES:
        f(spark, docs, SF).write.parquet(str(at / name))
        docs = out[name] = spark.read.parquet(str(at / name))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == P.COLUMNS
    assert {"doc_id", "text", "taken"} <= set(stages["mixing"].columns)


def test_each_stage_against_brute_force(spark, stages):
    scores = quality_scores(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages["quality"]) == {r.doc_id for r in scores.collect() if r.predicted == 1}
    last = {}
    for r in stages["quality"].collect():
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    assert ids(stages["exact"]) == set(last.values())
    rows = [(r.doc_id, r.text) for r in stages["exact"].collect()]
    assert ids(stages["near"]) == {i for i, _, c in brute(rows, 5, 80) if i == c}
    tests = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in stages["near"].collect() if any(" ".join(t) in " ".join((r.text or "").lower().split()) for t in tests)}
    assert leaks and ids(stages["decontaminate"]) == ids(stages["near"]) - leaks
    assert all(r.taken > 0 and r.taken % r.size == 0 for r in stages["mixing"].collect())


def test_run_equals_the_stages(spark, stages):
    cols = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, P.run(spark, SF).select(cols).collect())) == sorted(map(tuple, stages["mixing"].select(cols).collect()))


def test_clean_rows_stay_whose_id_is_shared_or_null(spark, make_docs):
    sf = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    text, clean = prose(1, 120), [(None, prose(2, 90)), (None, None), (None, ""), (7, prose(3, 90))]
    docs = make_docs([(1, text), (None, text + " tail"), (7, text + " end"), *clean])
    assert sorted(map(str, P.near(spark, docs, sf).select("doc_id", "text").collect())) == sorted(str(Row(doc_id=i, text=t)) for i, t in [(1, text), *clean])
    docs = make_docs([(None, leak), (7, leak + " " + prose(4, 50)), *clean])
    assert sorted(map(str, P.decontaminate(spark, docs, sf).select("doc_id", "text").collect())) == sorted(str(Row(doc_id=i, text=t)) for i, t in clean)


def test_edges_and_empty_tables(spark, make_docs):
    for rows in (EDGES, []):
        docs = make_docs(rows)
        for _, f in P.STAGES:
            docs = f(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() <= len(rows)
    assert near_dedup(make_docs([])).count() == 0 and contaminated(make_docs([]), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).count() == 0

import duckdb
import public_tokenizers
import pytest

from driftlog.llm import queries

TABLES = "documents pages benchmark labels".split()
#: Columns that the contracts ask for, by query.
COLUMNS = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_near_dedup": "doc_id n_shingles component_id kept",
    "op4_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_fuzzy_lines": "doc_id n_lines n_dropped text_sha256",
    "op7_warc_derivatives": "page_id record_type record_id refers_to block_digest payload_digest",
    "op8_quality": "doc_id held_out score predicted",
    "op9_decontamination": "doc_id item_id score",
    "op10_source_mix": "doc_id size source_size target taken",
}


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_whole_table(spark, sf, tables, name):
    df = queries.QUERIES[name](spark, sf)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    n = df.count()
    if name == "op7_warc_derivatives":
        assert n == 2 * tables.execute("select count(*) from pages").fetchall()[0][0]
    elif name != "op9_decontamination":
        assert n == tables.execute("select count(*) from documents").fetchall()[0][0]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_its_sql(spark, sf, tables, name):
    df = queries.QUERIES[name](spark, sf)
    cur = tables.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    form = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    assert sorted(form([r[c] for c in cols]) for r in df.collect()) == sorted(form([r[names.index(c)] for c in cols]) for r in cur.fetchall())


def test_near_duplicates_equal_brute_force(spark):
    from .test_near_dedup import brute

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in queries.op3_near_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(brute(rows, 3, 85))


def test_texts_that_are_not_utf8_go_through(spark):
    from driftlog.llm.decontaminate import contaminated
    from driftlog.llm.exact_dedup import exact_dedup
    from driftlog.llm.language_model import lm_scores
    from driftlog.llm.license_scan import license_scan
    from driftlog.llm.mixing import mix
    from driftlog.llm.near_dedup import near_dedup
    from driftlog.llm.token_counts import token_counts

    docs = spark.sql("select id as doc_id, concat('one two three four five ', cast(unhex(bad) as string), ' six') as text, 's' as source from values (1L, 'FF'), (2L, 'FF'), (3L, 'C328') as t(id, bad)")
    items = docs.selectExpr("doc_id as item_id", "text")
    assert [r.n_tokens > 0 for r in token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()] == [True] * 3
    assert sorted(r.component_id for r in near_dedup(docs, 3, 85).collect()) == [1, 1, 3]
    assert {r.n_tokens for r in lm_scores(docs).collect()} == {8}
    assert contaminated(docs, items).count() >= 3
    for f in (exact_dedup, license_scan, mix):
        assert f(docs).count() == 3

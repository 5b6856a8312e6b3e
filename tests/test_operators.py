import pytest
from pyspark.sql import functions as F

from driftlog.operators import relations as R
from driftlog.operators import replay
from driftlog.operators import selection as S

def gone():
    return F.col("gone")


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "a", False), (2, "b", False), (3, "a", False), (4, "b", True), (5, "c", False), (6, "c", True), (7, "c", False), (8, None, False)]
    return spark.createDataFrame(rows, "seq long, id string, gone boolean")


def test_last_row_wins_and_tombstones_delete(log):
    assert sorted(r["seq"] for r in replay.live(log, "id", "seq", gone()).collect()) == [3, 7, 8]


def test_versions_restart_after_a_tombstone(log):
    got = {r["seq"]: r["version"] for r in replay.versions(log, "id", "seq", gone()).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 5: 1, 7: 1, 8: 1}


def test_versions_go_on_from_a_base(spark):
    df = spark.createDataFrame([(1, "a", False, 5), (2, "a", False, None)], "seq long, id string, gone boolean, base int")
    assert [r["version"] for r in replay.versions(df, "id", "seq", gone(), F.col("base")).orderBy("seq").collect()] == [5, 6]


def test_stats(log):
    assert tuple(replay.stats(log, "id", "seq", gone()).first()) == (8, 2, 3)
    assert tuple(replay.stats(log.limit(0), "id", "seq", gone()).first()) == (0, 0, 0)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Alice", 30, 1.0, True), (2, "Bob", None, 2.5, False), (3, None, 25, 10.0, None)], "id long, name string, age int, score double, active boolean")


@pytest.mark.parametrize("cond,want", [({}, [1, 2, 3]), ({"age": "30"}, [1]), ({"age": 30}, [1]), ({"name": ""}, [3]), ({"name": None}, [3]), ({"active": 1}, [1]), ({"active": False}, [2, 3]), ({"score": "10"}, [3]), ({"score": 2.5, "name": "Bob"}, [2]), ({"nope": 1}, [])])
def test_equality(people, cond, want):
    assert sorted(r["id"] for r in S.where(people, cond).collect()) == want


def test_ranges(people):
    ids = lambda df: [r["id"] for r in df.collect()]
    assert sorted(ids(S.between(people, "score", 1.0, 2.5))) == [1, 2]
    assert ids(S.between(people, "score", None, None, None, "id", 2)) == [1, 2]
    assert ids(S.between(people, "score", 1.5, 20.5, by_key=True)) == [2]  # whole numbers are of another type
    assert sorted(ids(S.between(people, "age", 25))) == [1, 3]


def test_pages_cover_everything_once(people):
    seen, cursor = [], None
    while got := [r["id"] for r in S.page(people, "id", 2, cursor).collect()]:
        seen += got
        cursor = got[-1]
    assert seen == [1, 2, 3]


def test_aggregates(people):
    got = S.aggregate(people, {"n": ("count", None), "s": ("sum", "age"), "a": ("avg", "age"), "mn": ("min", "score"), "b": ("sum", "active"), "t": ("max", "name")}).first()
    assert tuple(got) == (3, 55.0, 55.0 / 3, 1.0, 0.0, None)
    none = S.aggregate(people, {"s": ("sum", "age"), "a": ("avg", "age"), "m": ("max", "age")}, {"id": 9}).first()
    assert tuple(none) == (0.0, None, None)
    with pytest.raises(ValueError):
        S.measure(people, "median", "age")


def test_through_keeps_duplicates_and_drops_dangling(spark):
    rel = R.ManyToMany("docs", "tags", "dt", "d", "t", ("w",))
    j = spark.createDataFrame([(1, 10, 5, 1), (1, 10, 7, 2), (1, 99, 1, 3), (2, 20, 2, 4)], "d long, t long, w int, seq long")
    tags = spark.createDataFrame([(10, "x"), (20, "y")], "id long, name string")
    got = R.through(rel, j, tags, "id", 1, seq="seq").collect()
    assert [(r["d"], r["id"], r["_junction"]["w"]) for r in got] == [(1, 10, 7), (1, 10, 7)]
    assert R.through(rel, j, tags, "id", conditions={"name": "y"}).count() == 1
    agg = R.aggregated(rel, R.through(rel, j, tags, "id").withColumn("v", F.lit("3")), {"s": ("sum", "v"), "n": ("count", None)}).collect()
    assert {(r["d"], r["s"], r["n"]) for r in agg} == {(1, 6.0, 2), (2, 3.0, 1)}


def test_conditions_cannot_replace_the_parent(spark):
    child = spark.createDataFrame([(1, 1)], "id long, fk long")
    with pytest.raises(ValueError):
        R.related(R.OneToMany("p", "c", "fk"), child, 1, {"fk": 2})


def test_temporal(spark):
    rel = R.Temporal("p", "c", "fk", "at", 100)
    child = spark.createDataFrame([(1, 1, 50), (2, 1, 150), (3, 1, None), (4, 2, 200)], "id long, fk long, at long")
    assert {r["id"]: r["_archived"] for r in R.related(rel, child, 1).collect()} == {1: True, 2: False, 3: None}
    assert [r["id"] for r in R.temporal_range(rel, child, 1, 60, 150).collect()] == [2]


def test_load_with_and_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (13, 7)], "cid long, fk long")
    got = {r["id"]: [c["cid"] for c in r["kids"]] for r in R.load_with(parent, "id", {"kids": (child, "fk", "cid")}, 2).collect()}
    assert got == {1: [10, 11], 2: []}
    assert [r["cid"] for r in R.orphans(child, "fk", parent, "id").collect()] == [13]


def test_registry():
    reg = R.Registry()
    reg.define("a", R.OneToMany("p", "c", "fk"))
    assert reg.has("a") and R.tables_of(reg.get("a")) == ["c", "p"]
    with pytest.raises(ValueError):
        reg.define("b", R.ManyToMany("p", "c", "j", "l", "r", ("l",)))
    with pytest.raises(ValueError):
        reg.define("no/name", R.Polymorphic("c", "t", "i"))
    reg.remove("a")
    assert not reg.has("a")

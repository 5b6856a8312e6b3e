"""The engine's queries over the test tables, with equivalent SQL for the oracle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coercion as C
from ..operators import relations as R
from ..operators import replay, selection as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CUTOFF = dt.datetime(2024, 1, 15)
CUSTOMER_ORDERS = R.OneToMany("customer", "orders", "o_custkey")
ORDER_LINES = R.OneToMany("orders", "lineitem", "l_orderkey")
ORDER_PARTS = R.ManyToMany("orders", "part", "lineitem", "l_orderkey", "l_partkey", ("l_quantity", "l_discount"))
EVENTS_OF = R.Polymorphic("events", "event_type", "user_id")
USER_EVENTS = R.Temporal("users", "events", "user_id", "ts", CUTOFF)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(table: str, sql: str | None = None, name: str | None = None):
    """Register a function of one or more tables, given by name, under its own name."""

    def add(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(*[read(spark, sf_dir, t) for t in table.split()])
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# Scans, filters, pages and ranges


@query("nation", "select * from nation")
def scan_all(nation):
    return nation


@query("orders", "select * from orders where o_orderkey = 42")
def select_by_id(orders):
    return S.where(orders, {"o_orderkey": 42})


@query("customer orders", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def exists_semi(customer, orders):
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_semi").select("c_custkey")


@query("orders", "select * from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW'")
def where_eq_and(orders):
    return S.where(orders, {"o_orderstatus": "F", "o_orderpriority": "5-LOW"})


@query("lineitem", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity = 10")
def where_coerced(lineitem):
    return S.where(lineitem, {"l_quantity": "10"}).select("l_orderkey", "l_linenumber", "l_quantity")


@query("orders", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' order by o_orderkey limit 25")
def where_limit(orders):
    return S.where(orders, {"o_orderstatus": "F"}, "o_orderkey", 25).select("o_orderkey", "o_custkey")


@query("orders", "select o_orderkey from orders order by o_orderkey limit 50")
def page_first(orders):
    return S.page(orders, "o_orderkey", 50).select("o_orderkey")


@query("orders", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderkey > 500 order by o_orderkey limit 50")
def page_next(orders):
    return S.page(orders, "o_orderkey", 50, 500, {"o_orderstatus": "O"}).select("o_orderkey")


@query("events", "select event_id, value from events where value between 10.0 and 20.0")
def range_num(events):
    return S.between(events, "value", 10.0, 20.0).select("event_id", "value")


@query("customer", "select c_custkey, c_mktsegment from customer where c_mktsegment between 'B' and 'H'")
def range_str(customer):
    return S.between(customer, "c_mktsegment", "B", "H").select("c_custkey", "c_mktsegment")


@query("events", "select event_id, value from events where value between 10.0 and 20.0 and event_type = 'click'")
def range_with_cond(events):
    return S.between(events, "value", 10.0, 20.0, {"event_type": "click"}).select("event_id", "value")


@query("events", "select event_id, value from events where value >= 50.0 order by value, event_id limit 20")
def range_limit(events):
    return S.between(events, "value", 50.0, None, None, "event_id", 20).select("event_id", "value")


@query("events", "select event_id from events where value >= 90.0")
def range_from(events):
    return S.between(events, "value", 90.0).select("event_id")


@query("events", "select event_id from events where value <= 5.0")
def range_to(events):
    return S.between(events, "value", None, 5.0).select("event_id")


@query("part", "select p_partkey, p_size from part where p_size = 15")
def indexed_eq(part):
    return S.where(part, {"p_size": 15}).select("p_partkey", "p_size")


KEY_SQL = "case when value = cast(value as bigint) then concat('I', lpad(cast(cast(value as bigint) + 1000000000000000 as string), 19, '0')) else concat('F', lpad(cast(cast(round(value * 1000) as bigint) + 1000000000000000 as string), 19, '0')) end"


@query("events", f"select event_id, {KEY_SQL} as sort_key from events")
def sort_key_compat(events):
    return events.select("event_id", C.sort_key(F.col("value"), events.schema["value"].dataType).alias("sort_key"))


@query("events", f"select event_id, value from events where {KEY_SQL} between 'F0001000000000010500' and 'F0001000000000020500'")
def range_by_key(events):
    return S.between(events, "value", 10.5, 20.5, by_key=True).select("event_id", "value")


@query("events", "select event_id from events where not (value between 10.0 and 90.0) or event_type in ('click', 'view')")
def where_or_not(events):
    return events.where(~F.col("value").between(10.0, 90.0) | F.col("event_type").isin("click", "view")).select("event_id")


# Aggregates


@query("orders", "select count(*) as n from orders")
def agg_count(orders):
    return S.aggregate(orders, {"n": ("count", None)})


@query("orders", "select coalesce(cast(sum(cast(o_totalprice as decimal(18,2))) as double), 0.0) as s from orders where o_orderstatus = 'F'")
def agg_sum(orders):
    return S.aggregate(orders, {"s": ("sum", "o_totalprice")}, {"o_orderstatus": "F"}, decimals=2)


@query("orders", "select cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice) as a from orders where o_orderstatus = 'F'")
def agg_avg(orders):
    return S.aggregate(orders, {"a": ("avg", "o_totalprice")}, {"o_orderstatus": "F"}, decimals=2)


@query("events", "select min(value) as mn, max(value) as mx from events where event_type = 'purchase'")
def agg_minmax(events):
    return S.aggregate(events, {"mn": ("min", "value"), "mx": ("max", "value")}, {"event_type": "purchase"})


@query("events", "select coalesce(sum(value), 0.0) as s, avg(value) as a, min(value) as mn, count(*) as n from events where event_type = 'none'")
def agg_empty(events):
    return S.aggregate(events, {"s": ("sum", "value"), "a": ("avg", "value"), "mn": ("min", "value"), "n": ("count", None)}, {"event_type": "none"})


@query("events", f"select arg_min(value, {KEY_SQL}) as lo, arg_max(value, {KEY_SQL}) as hi from events")
def agg_edges(events):
    lo, hi = (S.edge(events, "value", largest).withColumn("k", F.lit(1)) for largest in (False, True))
    return lo.withColumnRenamed("value", "lo").join(hi.withColumnRenamed("value", "hi"), "k").drop("k")


@query("events", f"select event_id, case when value = cast(value as bigint) then value else cast(round(value * 1000) as bigint) / 1000.0 end as value from events")
def sort_key_decoded(events):
    key = C.sort_key(F.col("value"), events.schema["value"].dataType)
    return events.select("event_id", C.decode_key(key).cast("double").alias("value"))


@query("orders", "select count(*) as n from orders where o_orderstatus = 'F'")
def count_where(orders):
    return S.aggregate(orders, {"n": ("count", None)}, {"o_orderstatus": "F"})


# Relations


@query("lineitem", "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey = 42")
def o2m_related(lineitem):
    return R.related(ORDER_LINES, lineitem, 42).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("customer orders", "select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey")
def o2m_all(customer, orders):
    return R.joined(CUSTOMER_ORDERS, customer, orders, "c_custkey").select("c_custkey", "o_orderkey")


@query("lineitem", "select l_orderkey, count(*) as n from lineitem group by l_orderkey")
def o2m_count(lineitem):
    return R.counts(ORDER_LINES, lineitem)


@query("orders", "select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as s, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice) as a, min(o_totalprice) as mn, max(o_totalprice) as mx from orders group by o_custkey")
def o2m_agg(orders):
    price = "o_totalprice"
    return R.aggregated(CUSTOMER_ORDERS, orders, {"s": ("sum", price), "a": ("avg", price), "mn": ("min", price), "mx": ("max", price)}, decimals=2)


@query("lineitem part", "select l_orderkey, p_partkey, p_name, l_quantity as j_quantity, l_discount as j_discount from lineitem join part on l_partkey = p_partkey")
def m2m_related(lineitem, part):
    found = R.through(ORDER_PARTS, lineitem, part, "p_partkey")
    return found.select("l_orderkey", "p_partkey", "p_name", F.col("_junction.l_quantity").alias("j_quantity"), F.col("_junction.l_discount").alias("j_discount"))


@query("lineitem part", "select l_orderkey, p_partkey, l_quantity as j_quantity from (select * from lineitem where l_orderkey = 42) join part on l_partkey = p_partkey")
def m2m_one(lineitem, part):
    return R.through(ORDER_PARTS, lineitem, part, "p_partkey", 42).select("l_orderkey", "p_partkey", F.col("_junction.l_quantity").alias("j_quantity"))


@query("lineitem", "select l_orderkey, count(*) as n from lineitem group by l_orderkey")
def m2m_count(lineitem):
    return R.counts(ORDER_PARTS, lineitem)


@query("lineitem part", "select l_orderkey, count(*) as n, cast(sum(cast(p_retailprice as decimal(18,2))) as double) as s, cast(sum(cast(p_retailprice as decimal(18,2))) as double) / count(p_retailprice) as a, min(p_retailprice) as mn, max(p_retailprice) as mx from lineitem join part on l_partkey = p_partkey where p_size = 15 group by l_orderkey")
def m2m_agg(lineitem, part):
    rows = R.through(ORDER_PARTS, lineitem, part, "p_partkey", conditions={"p_size": 15})
    price = "p_retailprice"
    return R.aggregated(ORDER_PARTS, rows, {"n": ("count", None), "s": ("sum", price), "a": ("avg", price), "mn": ("min", price), "mx": ("max", price)}, decimals=2)


@query("events", "select event_id, event_type, user_id from events where event_type = 'purchase' and user_id = 46")
def polymorphic(events):
    return R.related(EVENTS_OF, events, 46, parent_table="purchase").select("event_id", "event_type", "user_id")


@query("events customer", "select c_custkey, event_id from customer join events on event_type = 'purchase' and user_id = c_custkey")
def polymorphic_all(events, customer):
    return R.polymorphic_joined(EVENTS_OF, customer, "purchase", "c_custkey", events).select("c_custkey", "event_id")


@query("events", "select event_id, user_id, ts < timestamp '2024-01-15 00:00:00' as archived from events where user_id = 46")
def temporal_annot(events):
    return R.related(USER_EVENTS, events, 46).select("event_id", "user_id", F.col("_archived").alias("archived"))


@query("events", "select event_id, user_id from events where user_id = 46 and ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-10 00:00:00'")
def temporal_range(events):
    return R.temporal_range(USER_EVENTS, events, 46, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 10)).select("event_id", "user_id")


@query("nation customer supplier", "select n_nationkey, n_name, (select count(*) from customer where c_nationkey = n_nationkey) as n_customers, (select count(*) from supplier where s_nationkey = n_nationkey) as n_suppliers from nation")
def load_with(nation, customer, supplier):
    loaded = R.load_with(nation, "n_nationkey", {"customers": (customer, "c_nationkey", "c_custkey"), "suppliers": (supplier, "s_nationkey", "s_suppkey")})
    return loaded.select("n_nationkey", "n_name", F.size("customers").cast("long").alias("n_customers"), F.size("suppliers").cast("long").alias("n_suppliers"))


@query("region nation", "select r_regionkey, n_nationkey from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) join region on n_regionkey = r_regionkey where k <= 3")
def load_with_limit(region, nation):
    loaded = R.load_with(region, "r_regionkey", {"nations": (nation, "n_regionkey", "n_nationkey")}, 3)
    return loaded.select("r_regionkey", F.explode("nations.n_nationkey").alias("n_nationkey"))


@query("orders customer", "select o_orderkey from orders o left join (select * from customer where c_acctbal > 0) c on o.o_custkey = c.c_custkey where c.c_custkey is null")
def fk_violations(orders, customer):
    return R.orphans(orders, "o_custkey", customer.where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


@query("lineitem", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def batch_dups(lineitem):
    return R.duplicates(lineitem, ["l_orderkey", "l_linenumber"])


@query("events", "select cast(sum(case when ts < timestamp '2024-01-15 00:00:00' then 1 else 0 end) as bigint) as skipped, cast(sum(case when ts >= timestamp '2024-01-15 00:00:00' then 1 else 0 end) as bigint) as deleted from events where user_id = 46")
def delete_children(events):
    rows = R.related(USER_EVENTS, events, 46)
    return rows.agg(F.sum(F.col("_archived").cast("bigint")).alias("skipped"), F.sum((~F.col("_archived")).cast("bigint")).alias("deleted"))


@query("lineitem part", "select l_orderkey, l_partkey from lineitem l where not exists (select 1 from part p where p.p_partkey = l.l_partkey and p.p_size = 15)")
def detach_anti(lineitem, part):
    gone = S.where(part, {"p_size": 15})
    return lineitem.join(gone, lineitem["l_partkey"] == gone["p_partkey"], "left_anti").select("l_orderkey", "l_partkey")


# Logs: events by user, where an error is a tombstone


def _gone():
    return F.col("event_type") == "error"


@query("events", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) t where rn = 1 and event_type <> 'error'")
def log_replay(events):
    return replay.live(events.select("user_id", "event_id", "event_type"), "user_id", "event_id", _gone())


@query("events", "select user_id, event_id, cast(least(65535, row_number() over (partition by user_id, ep order by event_id)) as int) as version from (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as ep from events) t where event_type <> 'error'")
def log_version(events):
    return replay.versions(events.select("user_id", "event_id", "event_type"), "user_id", "event_id", _gone()).select("user_id", "event_id", "version")


@query("events", "select count(*) as total_lines, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as deleted_records, cast(sum(case when rn = 1 and event_type <> 'error' then 1 else 0 end) as bigint) as active_records from (select event_type, row_number() over (partition by user_id order by event_id desc) as rn from events) t")
def log_stats(events):
    return replay.stats(events, "user_id", "event_id", _gone())


@query("events", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_field(events):
    return events.select("event_id", C.field_text(F.parse_json("props"), "k").alias("k"))


# The record store

from . import store_queries  # noqa: E402

QUERIES |= store_queries.QUERIES
SQL |= store_queries.SQL

"""A database of schemaless record tables kept as logs, with batches, versions, transactions and relations.

Every change appends rows to a table's log as a Parquet segment and becomes
visible with one manifest commit. All work is set-oriented: a call for one
record is a batch of one.
"""

from __future__ import annotations

import contextlib
import copy
import json
import logging
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coercion as C
from ..operators import relations as R
from ..operators import replay
from ..sources.files import Files, local
from ..sources.jsonl import read_log
from ..sources.manifest import LockTimeout, Manifest

log = logging.getLogger("driftlog")
LOG = "seq long, id string, deleted boolean, version int, body string"


class Conflict(ValueError):
    """A duplicate id, a missing record, or a version that has moved on."""


@dataclass
class Config:
    lock_timeout_ms: int = 500
    max_name: int = 64
    name_pattern: str = r"^[a-zA-Z0-9_]+$"
    auto_compact: bool = False
    compact_ratio: float = 0.30
    compact_bytes: int = 5 << 20
    #: With auto_compact a table of so many segments is rewritten whatever its waste, as each change adds one.
    compact_segments: int = 200
    #: Relation reads to Python fail beyond so many rows; frames have no such cap.
    max_query_results: int = 10_000
    #: Deletes and replacements of children that touch so many rows or more fail before any write; 0: none do.
    max_scan_rows: int = 0
    enforce_foreign_keys: bool = False
    index_files: int = 8

    def configure(self, **values: Any) -> None:
        """Set known keys; an unknown one changes nothing and raises."""
        if bad := values.keys() - {f.name for f in fields(self)}:
            raise KeyError(", ".join(sorted(bad)))
        for k, v in values.items():
            setattr(self, k, v)

    def reset(self) -> None:
        """All keys at their defaults."""
        for f in fields(self):
            setattr(self, f.name, f.default)


class Database:
    """Tables under ``base``, which may be any path of Spark's; manifests and locks are in ``manifest``, a folder of the driver's file system, by default ``base``."""

    def __init__(self, spark: SparkSession, base: str, config: Config | None = None, manifest: str | None = None) -> None:
        self.spark, self.base, self.config = spark, base.rstrip("/"), config or Config()
        at = local(manifest or self.base)
        if at is None:
            raise ValueError(f"{manifest or self.base} can't hold manifests: name a local folder as well")
        self.manifest = Manifest(at, self.config.lock_timeout_ms)
        self.files = Files(spark)
        self.relations = R.Registry()

    def check_name(self, name: str) -> str:
        if not isinstance(name, str) or len(name) > self.config.max_name or not re.match(self.config.name_pattern, name) or any(x in name for x in ("..", "/", "\\")):
            raise ValueError(f"{name!r} is no name for a table")
        return name

    def table(self, name: str) -> Table:
        return Table(self, self.check_name(name))

    def tables(self) -> list[str]:
        return sorted(self.manifest.current()["tables"])

    @contextlib.contextmanager
    def transaction(self, names: list[str]) -> Iterator[Transaction]:
        """All changes to the named tables or none: visible with one commit at the end, dropped on any error."""
        with self.manifest.locked([self.check_name(n) for n in names]):
            tx = Transaction(self, names)
            try:
                yield tx
                tx.commit()
            except BaseException:
                tx.rollback()
                raise

    def recover(self) -> int:
        """Delete segments that no manifest names, as a writer that died leaves them; how many there were.

        A table that a live writer holds is left alone: its lock goes with the
        process that took it, and what is staged is looked at under the lock.
        """
        staged: dict[str, list[str]] = {}
        for p in self.files.glob(f"{self.base}/*/seg-*"):
            staged.setdefault(p.rsplit("/", 2)[1], []).append(p)
        n = 0
        for name, paths in staged.items():
            try:
                with self.manifest.locked([name], timeout=0):
                    known = self.manifest.named()
                    gone = [p for p in paths if "/".join(p.rsplit("/", 2)[1:]) not in known]
                    for p in gone:
                        self.files.delete(p)
                    n += len(gone)
            except LockTimeout:
                log.info("%s has a writer", name)
        return n

    # Relations

    def related(self, name: str, parent_id: Any, conditions: dict[str, Any] | None = None, limit: int = 0, parent_table: str | None = None) -> DataFrame:
        """(id, body, record[, _junction, _archived]) of the children of one parent."""
        r = self.relations.get(name)
        child = self.table(r.child)
        if not isinstance(r, R.ManyToMany):
            own = {r.type_field: parent_table, r.id_field: parent_id} if isinstance(r, R.Polymorphic) else {r.fk: parent_id}
            out = child.where(own | R._free(r, conditions), limit)
            at = C.field_number(F.col("record"), r.at) if isinstance(r, R.Temporal) else None
            return out.withColumn("_archived", at < r.cutoff) if at is not None and r.cutoff is not None else out
        j = self.table(r.junction).live()
        text = lambda f: C.field_text(F.col("record"), f)
        j = j.where(text(r.left_fk) == C.text_of(parent_id)).orderBy("seq")
        j = (j.limit(limit) if limit else j).select(text(r.right_fk).alias("_right"), "seq", F.struct(*[text(f).alias(f) for f in r.payload] or [F.lit(None).cast("string").alias("_")]).alias("_payload"))
        last = F.max_by("_payload", "seq")
        payload = j.groupBy("_right").agg(last.alias("_junction"))
        out = j.select("_right").join(payload, "_right").join(child.where(R._free(r, conditions)), F.col("_right") == F.col("id"))
        return out.drop("_right") if r.payload else out.drop("_right", "_junction")

    def count_related(self, name: str, parent_id: Any, conditions: dict[str, Any] | None = None) -> int:
        """Children, or of a many-to-many relation junction rows, to which the conditions then apply."""
        r = self.relations.get(name)
        if isinstance(r, R.ManyToMany):
            return self.table(r.junction).where({r.left_fk: parent_id} | (conditions or {})).count()
        return self.related(name, parent_id, conditions).count()

    def aggregate_related(self, name: str, parent_id: Any, fn: str, field: str | None = None, conditions: dict[str, Any] | None = None) -> float | int | None:
        r = self.relations.get(name)
        many = isinstance(r, R.ManyToMany)
        got = record_aggregate(self.related(name, parent_id, conditions), fn, field, numbers_only=many)
        return None if many and fn == "sum" and got[1] == 0 else got[0]

    def load_with(self, parent: str, parent_id: Any, names: list[str], limits: dict[str, int] | None = None) -> dict | None:
        """A parent's record with a list of children under the name of each relation; None without parent."""
        out = self.table(parent).find(parent_id)
        if out is not None:
            for n in names:
                out[n] = self.records(self.related(n, parent_id, None, (limits or {}).get(n, 0), parent))
        return out

    def temporal_range(self, name: str, parent_id: Any, low: float, high: float = 0, conditions: dict[str, Any] | None = None) -> DataFrame:
        """Children with ``low <= time <= high`` (0: open), a missing time being 0; rows before the cutoff are marked."""
        r = self.relations.get(name)
        if low < 0:
            raise ValueError("times start at 0")
        at = F.coalesce(C.field_number(F.col("record"), r.at), F.lit(0.0))
        out = self.table(r.child).where({r.fk: parent_id} | R._free(r, conditions)).where(at >= low)
        out = out.where(at <= high) if high else out
        return out.withColumn("_archived", at < r.cutoff) if r.cutoff else out

    def records(self, rows: DataFrame) -> list[dict]:
        """Rows as dictionaries; fails beyond ``max_query_results``, as the driver holds them."""
        most = self.config.max_query_results
        got = rows.drop("record").limit(most + 1).collect()
        if len(got) > most:
            raise Conflict(f"more than {most} rows")
        out = []
        for row in got:
            r = json.loads(row["body"])
            if "_junction" in row and row["_junction"] is not None:
                r["_junction"] = {k: v for k, v in row["_junction"].asDict().items() if v is not None}
            if "_archived" in row and row["_archived"] is not None:
                r["_archived"] = row["_archived"]
            out.append(r)
        return out

    def _need(self, *records: tuple[str, Any]) -> None:
        """With foreign keys enforced, fail unless all (table, id) exist."""
        for table, i in records if self.config.enforce_foreign_keys else ():
            if not self.table(table).exists(i):
                raise Conflict(f"{table} has no {i}")

    def _bounded(self, n: int) -> None:
        if 0 < self.config.max_scan_rows <= n:
            raise Conflict(f"{n} rows of at most {self.config.max_scan_rows}")

    def attach(self, name: str, parent_id: Any, child_id: Any, payload: dict[str, Any] | None = None) -> str:
        """Put or replace the junction row of a pair; its id."""
        r, payload = self.relations.get(name), payload or {}
        if bad := payload.keys() - {*r.payload}:
            raise ValueError(f"payload has {', '.join(sorted(bad))}")
        self._need((r.parent, parent_id), (r.child, child_id))
        junction, row = self.table(r.junction), {r.left_fk: parent_id, r.right_fk: child_id, **payload}
        was = junction.where({r.left_fk: parent_id, r.right_fk: child_id}).orderBy("seq").limit(1).collect()
        if was:
            junction.update(was[0]["id"], row)
            return was[0]["id"]
        return junction.insert(row)

    def detach(self, name: str, parent_id: Any, child_id: Any) -> int:
        r = self.relations.get(name)
        self._need((r.parent, parent_id), (r.child, child_id))
        return self.table(r.junction).delete_where({r.left_fk: parent_id, r.right_fk: child_id})

    def _check_children(self, r: R.Relation, rows: list[dict]) -> None:
        if any(r.fk in row for row in rows):
            raise ValueError(f"rows bring {r.fk} along")
        if isinstance(r, R.Temporal) and r.cutoff and any(float(row.get(r.at) or 0) < r.cutoff for row in rows):
            raise Conflict("rows before the cutoff are archived")

    def insert_with_children(self, parent: str, record: dict, name: str, rows: list[dict]) -> dict:
        r = self.relations.get(name)
        self._check_children(r, rows)
        with self.transaction([parent, r.child]) as tx:
            pid = tx.table(parent).insert(record)
            ids = tx.table(r.child).insert_batch([row | {r.fk: pid} for row in rows])
        return {"parent_id": pid, "child_ids": ids}

    def _current(self, r: R.Relation, child: Table, parent_id: Any) -> tuple[DataFrame, int]:
        """Children that may go, and how many are archived."""
        rows = child.where({r.left_fk if isinstance(r, R.ManyToMany) else r.fk: parent_id})
        if not isinstance(r, R.Temporal) or not r.cutoff:
            return rows, 0
        old = F.coalesce(C.field_number(F.col("record"), r.at), F.lit(0.0)) < r.cutoff
        return rows.where(~old), rows.where(old).count()

    def delete_with_children(self, name: str, parent_id: Any, delete_parent: bool = False) -> dict:
        """Delete children (of a many-to-many relation, junction rows); archived ones are skipped."""
        r = self.relations.get(name)
        child = r.junction if isinstance(r, R.ManyToMany) else r.child
        if not isinstance(r, R.ManyToMany) and not delete_parent:
            self._need((r.parent, parent_id))
        with self.transaction([child, r.parent] if delete_parent else [child]) as tx:
            rows, skipped = self._current(r, tx.table(child), parent_id)
            if self.config.max_scan_rows:
                self._bounded(rows.count() + skipped)
            out = {"deleted": tx.table(child).delete_rows(rows), "skipped": skipped}
            if delete_parent:
                tx.table(r.parent).delete(parent_id)
                out["parent_deleted"] = True
        return out

    def sync_children(self, name: str, parent_id: Any, rows: list[dict]) -> dict:
        """Replace all children that aren't archived."""
        r = self.relations.get(name)
        self._check_children(r, rows)
        self._need((r.parent, parent_id))
        with self.transaction([r.child]) as tx:
            child = tx.table(r.child)
            old, skipped = self._current(r, child, parent_id)
            if self.config.max_scan_rows:
                self._bounded(old.count() + skipped)
            deleted = child.delete_rows(old)
            return {"deleted": deleted, "skipped": skipped, "inserted": len(child.insert_batch([row | {r.fk: parent_id} for row in rows]))}


def record_aggregate(rows: DataFrame, fn: str, field: str | None, numbers_only: bool = False) -> tuple[float | int | None, int]:
    """The aggregate over a field of records, and the number of numeric values in it."""
    fn = fn.strip().lower()
    if fn == "count":
        n = rows.count()
        return n, n
    if fn not in ("sum", "avg", "min", "max"):
        raise ValueError(f"no aggregate {fn}")
    value, has = C.field_number(F.col("record"), field), C.has_field(F.col("record"), field)
    got = rows.select(value.alias("v"), has.alias("h")).agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.count_if("h").alias("h"), F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    total = got["s"] or 0.0
    below = got["n"] if numbers_only else got["h"]
    return {"sum": total, "avg": total / below if below else None, "min": got["mn"], "max": got["mx"]}[fn], got["n"]


class Table:
    """One table at the newest state, or at the state of a transaction."""

    def __init__(self, db: Database, name: str, tx: Transaction | None = None) -> None:
        self.db, self.name, self.tx = db, name, tx

    # State

    def _state(self) -> dict:
        state = self.tx.state if self.tx else self.db.manifest.current()
        return state["tables"].get(self.name) or {"segments": [], "next_seq": 0, "next_id": 1, "indexes": {}, "changed": 0}

    @contextlib.contextmanager
    def _changing(self) -> Iterator[dict]:
        """The table's state, to be changed; committed on leaving, by the transaction if there is one."""
        if self.tx:
            yield self.tx.state["tables"].setdefault(self.name, self._state())
            return
        with self.db.transaction([self.name]) as tx:
            self.tx = tx
            try:
                yield tx.state["tables"].setdefault(self.name, self._state())
            finally:
                self.tx = None
        if self.db.config.auto_compact:
            self._maybe_compact()

    def _append(self, t: dict, rows: DataFrame | list[tuple], n: int) -> None:
        path = f"{self.name}/seg-{uuid.uuid4().hex}"
        df = rows if isinstance(rows, DataFrame) else self.db.spark.createDataFrame(rows, LOG).coalesce(1)
        df.write.parquet(f"{self.db.base}/{path}")
        t["segments"].append({"path": path, "from": t["next_seq"], "n": n})
        t["next_seq"] += n
        t["changed"] = t["next_seq"]

    # Reads

    def log(self) -> DataFrame:
        paths = [f"{self.db.base}/{s['path']}" for s in self._state()["segments"]]
        reader = self.db.spark.read.schema(LOG)
        return reader.parquet(*paths) if paths else self.db.spark.createDataFrame([], LOG)

    def live(self) -> DataFrame:
        """(seq, id, version, body, record): the last row of each id unless deleted."""
        rows = replay.live(self.log(), "id", "seq", F.col("deleted"))
        return rows.select("seq", "id", "version", "body", F.parse_json("body").alias("record"))

    def versions(self) -> DataFrame:
        """All live and earlier rows with the version that each had."""
        return replay.versions(self.log().withColumnRenamed("version", "base"), "id", "seq", F.col("deleted"), F.col("base"))

    def find(self, id_: Any) -> dict | None:
        row = replay.live(self.log().where(F.col("id") == C.normal_id(id_)), "id", "seq", F.col("deleted")).first()
        return None if row is None else json.loads(row["body"])

    def exists(self, id_: Any) -> bool:
        return self.find(id_) is not None

    def version(self, id_: Any) -> int | None:
        """Of a live record; None if there is none. One job, over the rows of the id."""
        one = self.log().where(F.col("id") == C.normal_id(id_)).withColumnRenamed("version", "base")
        one = one.withColumn("last", F.max("seq").over(Window.partitionBy("id")))
        row = replay.versions(one, "id", "seq", F.col("deleted"), F.col("base")).where("seq = last").first()
        return row and row["version"]

    def _matches(self, conditions: dict[str, Any]) -> Column:
        return reduce(lambda a, b: a & b, [C.field_text(F.col("record"), f).eqNullSafe(F.lit(C.text_of(v))) for f, v in conditions.items()], F.lit(True))

    def where(self, conditions: dict[str, Any] | None = None, limit: int = 0) -> DataFrame:
        """Live rows whose fields equal all values as text; a missing field equals nothing. A limit takes the first ids."""
        out = self.live()
        out = out.where(self._matches(conditions)) if conditions else out
        return out.orderBy("id").limit(limit) if limit else out

    def each(self, fn: Callable[[dict], Any], conditions: dict[str, Any] | None = None, limit: int = 0, rows: DataFrame | None = None) -> int:
        """Call ``fn`` on each record until it returns False; records come through the driver a partition at a time."""
        n = 0
        for row in (self.where(conditions, limit) if rows is None else rows).drop("record").toLocalIterator():
            n += 1
            if fn(json.loads(row["body"])) is False:
                break
        return n

    def page(self, size: int, cursor: str | None = None, conditions: dict[str, Any] | None = None) -> dict:
        """The next records after ``cursor`` in order of id, and the cursor for more."""
        size = max(1, size)
        rows = self.where(conditions)
        rows = rows.where(F.col("id") > cursor) if cursor is not None else rows
        got = rows.drop("record").orderBy("id").limit(size + 1).collect()
        kept = got[:size]
        return {"records": [json.loads(r["body"]) for r in kept], "next_cursor": kept[-1]["id"] if len(got) > size else None, "has_more": len(got) > size, "count": len(kept)}

    def range(self, field: str, low: Any = None, high: Any = None, conditions: dict[str, Any] | None = None, limit: int = 0) -> DataFrame:
        """(key, seq, id, body, record) with the field's sort key from that of ``low`` to that of ``high``, in order of key and id.

        A configured index is rebuilt if the table has changed and then read
        with the bounds pushed to its sorted files; without one the table is scanned.
        """
        if field in self._state()["indexes"]:
            if self.index_stale(field):
                self.build_index(field)
            rows = self.db.spark.read.parquet(f"{self.db.base}/{self._state()['indexes'][field]['path']}")
            rows = rows.withColumn("record", F.parse_json("body"))
        else:
            live = self.live()
            rows = live.withColumn("key", C.field_key(F.col("record"), field)).where("key is not null").select("key", "seq", "id", "body", "record")
        rows = rows if low is None else rows.where(F.col("key") >= C.key_of(low))
        rows = rows if high is None else rows.where(F.col("key") <= C.key_of(high))
        rows = rows.where(self._matches(conditions)) if conditions else rows
        rows = rows.orderBy("key", "id")
        return rows.limit(limit) if limit else rows

    def count(self) -> int:
        return replay.live(self.log().select("id", "seq", "deleted"), "id", "seq", F.col("deleted")).count()

    def aggregate(self, fn: str, field: str | None = None, conditions: dict[str, Any] | None = None) -> float | int | None:
        return record_aggregate(self.where(conditions), fn, field)[0]

    def edge(self, field: str, largest: bool = False) -> Any:
        """The value with the first or last sort key, whatever its type; null and missing fields aside."""
        key = C.field_key(F.col("record"), field)
        rows = self.live().select(key.alias("k"), C.field_text(F.col("record"), field).alias("v")).where("k is not null and k <> 'S'")
        return rows.agg((F.max_by if largest else F.min_by)("v", "k")).first()[0]

    def stats(self) -> dict:
        s = replay.stats(self.log(), "id", "seq", F.col("deleted")).first().asDict()
        total, gone, active = s["total_lines"], s["deleted_records"], s["active_records"]
        size = self._size()
        return s | {"obsolete_versions": max(0, total - active - gone), "fragmentation_percent": round(100 * gone / total, 2) if total else 0.0, "file_size": size, "segments": len(self._state()["segments"]), "next_id": self._state()["next_id"], "stale_indexes": sorted(f for f in self._state()["indexes"] if self.index_stale(f)), "secondary_indexes": self._index_stats()}

    def _index_stats(self) -> dict[str, dict]:
        out = {}
        for f, index in sorted(self._state()["indexes"].items()):
            rows = self.db.spark.read.parquet(f"{self.db.base}/{index['path']}")
            files = rows.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").count().agg(F.sum("file_size").alias("s"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("f")).first()
            out[f] = {"entries": files["n"] or 0, "files": files["f"], "file_size": files["s"] or 0, "built_at": index["built_at"], "stale": self.index_stale(f)}
        return out

    def _size(self) -> int:
        if not self._state()["segments"]:
            return 0
        files = self.log().select("_metadata.file_path", "_metadata.file_size").distinct()
        return files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]

    # Writes

    @staticmethod
    def _body(record: dict, id_: Any) -> str:
        if "_deleted" in record:
            raise ValueError("_deleted is reserved")
        return json.dumps({**record, "id": id_}, ensure_ascii=False, separators=(",", ":"))

    def insert(self, record: dict, id_: Any = None) -> Any:
        if not record:
            raise ValueError("nothing to insert")
        return self.insert_batch([record if id_ is None else {**record, "id": id_}])[0]

    def insert_batch(self, records: list[dict]) -> list[Any]:
        """All records or none; those without id get the next numbers. The ids, in order."""
        if not records:
            return []
        with self._changing() as t:
            ids, keys = [], []
            for r in records:
                if not r:
                    raise ValueError("nothing to insert")
                given = r.get("id")
                if given is None:
                    given, t["next_id"] = t["next_id"], t["next_id"] + 1
                ids.append(given)
                keys.append(C.normal_id(given))
                if keys[-1] == "":
                    raise ValueError("an id can't be empty")
                if keys[-1].isdigit():  # numbers that were given aren't dealt out again
                    t["next_id"] = max(t["next_id"], int(keys[-1]) + 1)
            if len({*keys}) < len(keys):
                raise Conflict("an id occurs twice")
            self._refuse_live(self.db.spark.createDataFrame([(k,) for k in keys], "id string"))
            rows = [(t["next_seq"] + i, k, False, None, self._body(r, g)) for i, (r, k, g) in enumerate(zip(records, keys, ids, strict=True))]
            self._append(t, rows, len(rows))
        return ids

    def _refuse_live(self, ids: DataFrame) -> None:
        known = replay.live(self.log().join(F.broadcast(ids), "id", "left_semi"), "id", "seq", F.col("deleted"))
        if row := known.first():
            raise Conflict(f"{row['id']} exists")

    def insert_frame(self, df: DataFrame, id_col: str = "id") -> int:
        """Insert all rows of a frame with ids of their own: checks and write are distributed. How many."""
        own = df.select(F.col(id_col).cast("string").alias("id"), F.to_json(F.struct(*[F.col(c) for c in df.columns if c != id_col], F.col(id_col).alias("id"))).alias("body"))
        with self._changing() as t:
            part = f"{self.db.base}/{self.name}/seg-{uuid.uuid4().hex}"
            own.withColumn("n", F.monotonically_increasing_id()).write.parquet(part)
            staged = self.db.spark.read.schema("id string, body string, n long").parquet(part)
            bad = staged.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
            live = replay.live(self.log(), "id", "seq", F.col("deleted"))
            if bad or staged.join(live.select("id"), "id", "left_semi").limit(1).count():
                self.db.files.delete(part)
                raise Conflict("an id occurs twice or exists")
            sizes = staged.groupBy(F.shiftright("n", 33).alias("p")).count().orderBy("p").collect()  # one row a task
            first, at = {}, t["next_seq"]
            for r in sizes:
                first[r["p"]], at = at, at + r["count"]
            offsets = self.db.spark.createDataFrame([*first.items()] or [(0, 0)], "p long, first long")
            rows = staged.join(F.broadcast(offsets), F.shiftright("n", 33) == F.col("p"))
            rows = rows.select((F.col("first") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("seq"), "id", F.lit(False).alias("deleted"), F.lit(None).cast("int").alias("version"), "body")
            n = at - t["next_seq"]
            largest = staged.agg(F.max(F.when(F.col("id").rlike(r"^\d+$"), F.col("id").try_cast("bigint")))).first()[0]
            t["next_id"] = max(t["next_id"], (largest or 0) + 1)
            self._append(t, rows, n)
            self.db.files.delete(part)
        return n

    def import_jsonl(self, path: str) -> int:
        """Append the lines of a record log, in order, tombstones included."""
        rows = read_log(self.db.spark, path).where("id is not null")
        with self._changing() as t:
            seq = (F.row_number().over(Window.orderBy("seq")) + F.lit(t["next_seq"] - 1)).cast("long")  # a log is one sequence
            rows = rows.select(seq.alias("seq"), "id", "deleted", F.lit(None).cast("int").alias("version"), "body")
            n = rows.count()
            top = rows.agg(F.max(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint"))).first()[0]
            t["next_id"] = max(t["next_id"], (top or 0) + 1)
            self._append(t, rows, n)
        return n

    def _expect(self, id_: Any, version: int | None) -> str:
        now = self.version(id_)
        if now is None or version is not None and now != version:
            raise Conflict(f"{id_} is at version {now}")
        return C.normal_id(id_)

    def update(self, id_: Any, record: dict, expected_version: int | None = None) -> None:
        """Replace a live record as a whole."""
        with self._changing() as t:
            key = self._expect(id_, expected_version)
            own = int(key) if key.lstrip("-").isdigit() else key
            self._append(t, [(t["next_seq"], key, False, None, self._body(record, own))], 1)

    def delete(self, id_: Any, expected_version: int | None = None) -> None:
        with self._changing() as t:
            key = self._expect(id_, expected_version)
            self._append(t, [(t["next_seq"], key, True, None, json.dumps({"id": key, "_deleted": True}))], 1)

    def delete_where(self, conditions: dict[str, Any]) -> int:
        with self._changing():
            return self.delete_rows(self.where(conditions))

    def delete_rows(self, rows: DataFrame) -> int:
        """Tombstones for rows of this table, written where they are."""
        with self._changing() as t:
            n = rows.count()
            if n:
                gone = rows.select(F.lit(t["next_seq"]).cast("long").alias("seq"), "id", F.lit(True).alias("deleted"), F.lit(None).cast("int").alias("version"), F.to_json(F.struct("id", F.lit(True).alias("_deleted"))).alias("body"))
                self._append(t, gone, 1)  # one place in the log: their order is of no matter
            return n

    def truncate(self, seq: int = 0) -> None:
        """Drop the log from ``seq`` on; 0 empties the table."""
        with self._changing() as t:
            rest = [s for s in t["segments"] if s["from"] + s["n"] <= seq]
            cut = [s for s in t["segments"] if s["from"] < seq < s["from"] + s["n"]]
            keep = self.log().where(F.col("seq") < seq) if cut else None
            t["segments"], t["indexes"] = rest, {}
            if keep is not None:
                t["next_seq"] = cut[0]["from"]
                self._append(t, keep, seq - cut[0]["from"])
            t["next_seq"] = t["changed"] = seq

    # Maintenance

    def compact(self) -> dict:
        """Rewrite the log as its live rows, with their versions, sorted by id with a Bloom filter on it for point lookups."""
        before = self.stats()
        with self._changing() as t:
            rows = self.versions()
            last = replay.live(self.log().select("id", "seq", "deleted"), "id", "seq", F.col("deleted")).select("id", "seq")
            live = rows.join(last, ["id", "seq"]).select("seq", "id", F.lit(False).alias("deleted"), "version", "body")
            path = f"{self.name}/seg-{uuid.uuid4().hex}"
            live.repartitionByRange(self.db.config.index_files, "id").sortWithinPartitions("id").write.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", str(max(1, before["active_records"]))).parquet(f"{self.db.base}/{path}")
            t["segments"] = [{"path": path, "from": 0, "n": t["next_seq"]}]
        size = self._size()
        removed = before["deleted_records"] + before["obsolete_versions"]
        return {"records_kept": before["active_records"], "deleted_records": before["deleted_records"], "obsolete_versions": before["obsolete_versions"], "records_removed": removed, "old_size": before["file_size"], "new_size": size, "space_saved": before["file_size"] - size}

    def _maybe_compact(self) -> None:
        s = self.stats()
        total = s["total_lines"]
        waste = (total - s["active_records"]) / total if total else 0
        wasted = waste >= min(1.0, max(0.01, self.db.config.compact_ratio)) and waste * s["file_size"] >= self.db.config.compact_bytes
        if wasted or s["segments"] >= self.db.config.compact_segments:
            self.compact()

    def configure_indexes(self, names: list[str]) -> None:
        for f in names:
            self.build_index(f)

    def build_index(self, field: str) -> None:
        """Live rows by sort key in range-partitioned, sorted files, so that bounds skip files and row groups."""
        with self._changing() as t:
            rows = self.live().withColumn("key", C.field_key(F.col("record"), field)).where("key is not null").select("key", "seq", "id", "body")
            path = f"{self.name}/seg-{uuid.uuid4().hex}"
            rows.repartitionByRange(self.db.config.index_files, "key", "id").sortWithinPartitions("key", "id").write.parquet(f"{self.db.base}/{path}")
            t["indexes"][field] = {"path": path, "built_at": t["changed"]}

    def index_stale(self, field: str) -> bool:
        s = self._state()
        return field not in s["indexes"] or s["indexes"][field]["built_at"] < s["changed"]

    def indexes(self) -> list[str]:
        return sorted(self._state()["indexes"])


class Transaction:
    """Staged changes to several tables; its own reads see them."""

    def __init__(self, db: Database, names: list[str]) -> None:
        self.db, self.names = db, {*names}
        self.begun = db.manifest.current()
        self.state = copy.deepcopy(self.begun)
        self.open = True

    def table(self, name: str) -> Table:
        if name not in self.names or not self.open:
            raise ValueError(f"{name} isn't part of an open transaction")
        return Table(self.db, name, self)

    def commit(self) -> None:
        """Publish; tables that others have committed meanwhile are theirs, as locks keep the named ones ours."""
        while self.open:
            now = self.db.manifest.current()
            now["tables"].update({n: self.state["tables"][n] for n in self.names if n in self.state["tables"]})
            try:
                self.db.manifest.commit(now)
            except FileExistsError:
                continue
            self.open = False

    def rollback(self) -> None:
        """Drop what was staged."""
        if self.open:
            known = {s["path"] for t in self.begun["tables"].values() for s in [*t["segments"], *t["indexes"].values()]}
            for n in self.names:
                t = self.state["tables"].get(n) or {"segments": [], "indexes": {}}
                for s in [*t["segments"], *t["indexes"].values()]:
                    if s["path"] not in known:
                        self.db.files.delete(f"{self.db.base}/{s['path']}")
            self.open = False

    def reset(self) -> None:
        """Drop what was staged and go on from the newest state."""
        self.rollback()
        self.begun = self.db.manifest.current()
        self.state, self.open = copy.deepcopy(self.begun), True

    def describe(self) -> str:
        """The staged state as text."""
        return json.dumps({n: self.state["tables"].get(n) for n in sorted(self.names)}, indent=2)

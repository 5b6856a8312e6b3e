"""The store with the conventions of a record API: no exceptions, but False for an error, None for nothing found.

The last error of each component can be asked for; failed changes can go to an
audit log.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark.sql import SparkSession

from ..operators import relations as R
from .store import Config, Database, Transaction

#: Changes whose errors go to the audit log.
AUDITED = {"insert", "insert_batch", "update", "delete", "compact", "truncate_table", "attach", "detach", "insert_with_children", "delete_with_children", "sync_children"}


class Errors:
    """The last error of each component and all of them in order."""

    def __init__(self, detailed: bool = False, audit_log: str | None = None) -> None:
        self.detailed, self.audit_log = detailed, audit_log
        self.last: dict[str, str] = {}
        self.stack: list[tuple[str, str, str]] = []

    def set(self, component: str, method: str, error: Exception) -> None:
        text = f"{type(error).__name__}: {error}" if self.detailed else str(error).splitlines()[0][:200] if isinstance(error, ValueError | KeyError | TimeoutError) else "operation failed"
        self.last[component] = text
        self.stack.append((component, method, text))
        if self.audit_log and method in AUDITED:
            with open(self.audit_log, "a") as out:
                out.write(json.dumps({"at": int(time.time()), "component": component, "method": method, "error": text}) + "\n")

    def clear(self, component: str | None = None) -> None:
        if component is None:
            self.last.clear(), self.stack.clear()
        else:
            self.last.pop(component, None)

    def format(self) -> str:
        return "\n".join(f"{c}.{m}: {t}" for c, m, t in self.stack)


def guarded(f: Callable) -> Callable:
    @functools.wraps(f)
    def call(self, *args, **kwargs):
        try:
            return f(self, *args, **kwargs)
        except Exception as e:
            self.errors.set(type(self).__name__, f.__name__, e)
            return False

    return call


class Manager:
    """Tables by name."""

    def __init__(self, spark: SparkSession, base: str, config: Config | None = None, detailed_errors: bool = False, audit_log: str | None = None) -> None:
        self.db = Database(spark, base, config)
        self.errors = Errors(detailed_errors, audit_log)

    def last_error(self) -> str | None:
        return self.errors.last.get(type(self).__name__)

    @guarded
    def configure(self, **values: Any) -> bool:
        self.db.config.configure(**values)
        return True

    @guarded
    def config(self, key: str | None = None) -> Any:
        """One setting, or all of them."""
        return asdict(self.db.config) if key is None else asdict(self.db.config)[key]

    # Reads

    @guarded
    def read_all(self, table: str) -> list[dict]:
        return self.db.records(self.db.table(table).where())

    @guarded
    def find_by_id(self, table: str, id_: Any) -> dict | None:
        return self.db.table(table).find(id_)

    @guarded
    def find_where(self, table: str, conditions: dict[str, Any], limit: int = 0) -> list[dict] | None:
        return self.db.records(self.db.table(table).where(conditions, limit)) or None

    @guarded
    def for_each_record(self, table: str, fn: Callable[[dict], Any], conditions: dict[str, Any] | None = None, limit: int = 0) -> int:
        return self.db.table(table).each(fn, conditions, limit)

    @guarded
    def select_page(self, table: str, size: int, cursor: str | None = None, conditions: dict[str, Any] | None = None) -> dict:
        return self.db.table(table).page(size, cursor, conditions)

    @guarded
    def select_range(self, table: str, field: str, low: Any = None, high: Any = None, conditions: dict[str, Any] | None = None, limit: int = 0) -> list[dict] | None:
        """Records of an indexed field's range in order of its key; False if the field has no index."""
        return self.db.records(self._indexed(table, field).range(field, low, high, conditions, limit)) or None

    @guarded
    def select_range_each(self, table: str, field: str, fn: Callable[[dict], Any], low: Any = None, high: Any = None, conditions: dict[str, Any] | None = None, limit: int = 0) -> int:
        t = self._indexed(table, field)
        return t.each(fn, rows=t.range(field, low, high, conditions, limit))

    def range_from(self, table: str, field: str, low: Any, conditions: dict[str, Any] | None = None, limit: int = 0) -> list[dict] | None:
        return self.select_range(table, field, low, None, conditions, limit)

    def range_to(self, table: str, field: str, high: Any, conditions: dict[str, Any] | None = None, limit: int = 0) -> list[dict] | None:
        return self.select_range(table, field, None, high, conditions, limit)

    def find_by_field(self, table: str, field: str, value: Any, conditions: dict[str, Any] | None = None, limit: int = 0) -> list[dict] | None:
        """Records whose field has the sort key of ``value``."""
        return self.select_range(table, field, value, value, conditions, limit)

    def _indexed(self, table: str, field: str):
        t = self.db.table(table)
        if field not in t.indexes():
            raise ValueError(f"{field} has no index")
        return t

    @guarded
    def exists(self, table: str, id_: Any) -> bool:
        return self.db.table(table).exists(id_)

    @guarded
    def count(self, table: str) -> int:
        return self.db.table(table).count()

    @guarded
    def aggregate(self, table: str, fn: str, field: str | None = None, conditions: dict[str, Any] | None = None) -> float | int | None:
        """min and max of an indexed field without conditions are those of its sort keys, of any type."""
        t, name = self.db.table(table), fn.strip().lower()
        if name in ("min", "max") and not conditions and field in t.indexes():
            got = t.edge(field, largest=name == "max")
            return got if got is None else _plain(got)
        return t.aggregate(name, field, conditions)

    @guarded
    def entry_version(self, table: str, id_: Any) -> int:
        return self.db.table(table).version(id_) or False

    @guarded
    def stats(self, table: str) -> dict:
        return self.db.table(table).stats()

    # Changes

    @guarded
    def insert(self, table: str, record: dict, id_: Any = None) -> Any:
        return self.db.table(table).insert(record, id_)

    @guarded
    def insert_batch(self, table: str, records: list[dict]) -> dict:
        ids = self.db.table(table).insert_batch(records)
        return {"inserted": len(ids), "ids": ids}

    @guarded
    def update(self, table: str, id_: Any, record: dict, expected_version: int | None = None) -> bool:
        self.db.table(table).update(id_, record, expected_version)
        return True

    @guarded
    def delete(self, table: str, id_: Any, expected_version: int | None = None) -> bool:
        self.db.table(table).delete(id_, expected_version)
        return True

    @guarded
    def compact(self, table: str) -> dict:
        return self.db.table(table).compact()

    @guarded
    def truncate_table(self, table: str, seq: int = 0) -> bool:
        self.db.table(table).truncate(seq)
        return True

    # Indexes

    @guarded
    def configure_secondary_indexes(self, table: str, names: list[str]) -> bool:
        self.db.table(table).configure_indexes(names)
        return True

    @guarded
    def rebuild_secondary_indexes(self, table: str) -> int:
        t = self.db.table(table)
        for f in t.indexes():
            t.build_index(f)
        return len(t.indexes())

    @guarded
    def secondary_indexes_need_rebuild(self, table: str) -> bool:
        t = self.db.table(table)
        return any(t.index_stale(f) for f in t.indexes())

    @guarded
    def has_secondary_index(self, table: str, field: str) -> bool:
        return field in self.db.table(table).indexes()

    @guarded
    def secondary_indexes(self, table: str) -> list[str]:
        return self.db.table(table).indexes()

    # Transactions

    def transaction(self, names: list[str], retries: int = 0):
        """A context of staged tables; taking the locks is tried again ``retries`` times."""
        return _Retried(self.db, names, retries)

    @guarded
    def recover(self) -> int:
        return self.db.recover()


class Aggregate(Manager):
    """Relations between tables, besides what a manager does."""

    @guarded
    def define_relation(self, name: str, relation: R.Relation) -> bool:
        self.db.relations.define(name, relation)
        return True

    def get_related(self, name: str, parent_id: Any, conditions: dict[str, Any] | None = None, limit: int = 0) -> list[dict] | None:
        return self._records("related", name, parent_id, conditions, limit)

    def get_polymorphic(self, name: str, parent_table: str, parent_id: Any, conditions: dict[str, Any] | None = None, limit: int = 0) -> list[dict] | None:
        return self._records("related", name, parent_id, conditions, limit, parent_table)

    def get_temporal_range(self, name: str, parent_id: Any, low: float, high: float = 0, conditions: dict[str, Any] | None = None) -> list[dict] | None:
        return self._records("temporal_range", name, parent_id, low, high, conditions)

    @guarded
    def _records(self, method: str, *args: Any) -> list[dict] | None:
        return self.db.records(getattr(self.db, method)(*args)) or None

    @guarded
    def count_related(self, name: str, parent_id: Any, conditions: dict[str, Any] | None = None) -> int:
        return self.db.count_related(name, parent_id, conditions)

    @guarded
    def aggregate_related(self, name: str, parent_id: Any, fn: str, field: str | None = None, conditions: dict[str, Any] | None = None) -> float | int | None:
        return self.db.aggregate_related(name, parent_id, fn, field, conditions)

    def sum_related(self, name: str, parent_id: Any, field: str, conditions: dict[str, Any] | None = None) -> float | None:
        return self.aggregate_related(name, parent_id, "sum", field, conditions)

    def avg_related(self, name: str, parent_id: Any, field: str, conditions: dict[str, Any] | None = None) -> float | None:
        return self.aggregate_related(name, parent_id, "avg", field, conditions)

    def min_related(self, name: str, parent_id: Any, field: str, conditions: dict[str, Any] | None = None) -> float | None:
        return self.aggregate_related(name, parent_id, "min", field, conditions)

    def max_related(self, name: str, parent_id: Any, field: str, conditions: dict[str, Any] | None = None) -> float | None:
        return self.aggregate_related(name, parent_id, "max", field, conditions)

    @guarded
    def load_with(self, parent_table: str, parent_id: Any, names: list[str], limits: dict[str, int] | None = None) -> dict | None:
        return self.db.load_with(parent_table, parent_id, names, limits)

    @guarded
    def attach(self, name: str, parent_id: Any, child_id: Any, payload: dict[str, Any] | None = None) -> Any:
        return self.db.attach(name, parent_id, child_id, payload)

    @guarded
    def detach(self, name: str, parent_id: Any, child_id: Any) -> bool:
        self.db.detach(name, parent_id, child_id)
        return True

    @guarded
    def insert_with_children(self, parent_table: str, record: dict, name: str, rows: list[dict]) -> dict:
        return self.db.insert_with_children(parent_table, record, name, rows)

    @guarded
    def delete_with_children(self, name: str, parent_id: Any, delete_parent: bool = False) -> dict:
        return self.db.delete_with_children(name, parent_id, delete_parent)

    @guarded
    def sync_children(self, name: str, parent_id: Any, rows: list[dict]) -> dict:
        return self.db.sync_children(name, parent_id, rows)


def _plain(text: str) -> Any:
    try:
        value = float(text)
    except ValueError:
        return text
    return int(value) if value.is_integer() and "e" not in text.lower() and "." not in text else value


class _Retried:
    def __init__(self, db: Database, names: list[str], retries: int) -> None:
        self.db, self.names, self.retries = db, names, retries

    def __enter__(self) -> Transaction:
        import random

        for k in range(self.retries + 1):
            self.context = self.db.transaction(self.names)
            try:
                return self.context.__enter__()
            except TimeoutError:
                if k == self.retries:
                    raise
                time.sleep(random.uniform(0, 0.05 * (k + 1)))

    def __exit__(self, *error: Any) -> bool | None:
        return self.context.__exit__(*error)

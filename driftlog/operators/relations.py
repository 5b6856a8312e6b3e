"""Relations between tables, compiled to joins.

Every read has two forms: for one parent, a filter that reaches the scan, and
for all parents at once, the same join without it. Join strategy is left to
adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import equals, matching, measure, where


@dataclass(frozen=True)
class OneToMany:
    parent: str
    child: str
    fk: str


@dataclass(frozen=True)
class ManyToMany:
    parent: str
    child: str
    junction: str
    left_fk: str
    right_fk: str
    payload: tuple[str, ...] = ()


@dataclass(frozen=True)
class Polymorphic:
    child: str
    type_field: str
    id_field: str


@dataclass(frozen=True)
class Temporal:
    parent: str
    child: str
    fk: str
    at: str
    #: Rows before this time are archived; None: none are.
    cutoff: Any = None


Relation = OneToMany | ManyToMany | Polymorphic | Temporal


def tables_of(relation: Relation) -> list[str]:
    return sorted({getattr(relation, n) for n in ("parent", "child", "junction") if hasattr(relation, n)})


def keys_of(relation: Relation) -> set[str]:
    return {getattr(relation, n) for n in ("fk", "left_fk", "right_fk", "type_field", "id_field") if hasattr(relation, n)}


@dataclass
class Registry:
    """Named relations."""

    known: dict[str, Relation] = field(default_factory=dict)

    def define(self, name: str, relation: Relation) -> None:
        if not name.replace("_", "").isalnum():
            raise ValueError(f"{name!r} is no name for a relation")
        if isinstance(relation, ManyToMany) and (bad := {"id", relation.left_fk, relation.right_fk} & {*relation.payload}):
            raise ValueError(f"payload can't hold {', '.join(sorted(bad))}")
        self.known[name] = relation

    def get(self, name: str) -> Relation:
        return self.known[name]

    def has(self, name: str) -> bool:
        return name in self.known

    def remove(self, name: str) -> None:
        self.known.pop(name, None)

    def clear(self) -> None:
        self.known.clear()


def _free(relation: Relation, conditions: dict[str, Any] | None) -> dict[str, Any]:
    """Conditions; those on a key column of the relation aren't allowed, as they would replace the parent."""
    if bad := keys_of(relation) & {*(conditions or {})}:
        raise ValueError(f"conditions on {', '.join(sorted(bad))}")
    return conditions or {}


def archived(relation: Temporal) -> Column:
    """Whether a row is before the cutoff; null where the row has no time."""
    return F.col(relation.at) < F.lit(relation.cutoff)


def related(relation: Relation, child: DataFrame, parent_id: Any, conditions: dict[str, Any] | None = None, order: str | None = None, limit: int = 0, parent_table: str | None = None) -> DataFrame:
    """Children of one parent. Temporal children carry ``_archived`` if the relation has a cutoff."""
    conditions = _free(relation, conditions)
    if isinstance(relation, Polymorphic):
        return where(child.where(equals(child, relation.type_field, parent_table) & equals(child, relation.id_field, parent_id)), conditions, order, limit)
    out = where(child.where(equals(child, relation.fk, parent_id)), conditions, order, limit)
    return out.withColumn("_archived", archived(relation)) if isinstance(relation, Temporal) and relation.cutoff is not None else out


def joined(relation: OneToMany | Temporal, parent: DataFrame, child: DataFrame, parent_key: str) -> DataFrame:
    """All parents with their children."""
    return parent.join(child, parent[parent_key] == child[relation.fk])


def polymorphic_joined(relation: Polymorphic, parent: DataFrame, parent_table: str, parent_key: str, child: DataFrame) -> DataFrame:
    """All parents of one table with their children."""
    return parent.join(child, (child[relation.type_field] == F.lit(parent_table)) & (child[relation.id_field] == parent[parent_key]))


def through(relation: ManyToMany, junction: DataFrame, child: DataFrame, child_key: str, parent_id: Any = None, conditions: dict[str, Any] | None = None, order: str | None = None, limit: int = 0, seq: str | None = None) -> DataFrame:
    """Children by junction rows, one row for each, with the payload as ``_junction``; junction rows without a child drop out.

    With ``limit``, junction rows are limited before children are filtered. With
    ``seq``, a pair that occurs again carries its last payload everywhere.
    """
    j = junction if parent_id is None else junction.where(equals(junction, relation.left_fk, parent_id))
    j = j.orderBy(order or relation.right_fk).limit(limit) if limit else j
    columns = [relation.left_fk, relation.right_fk]
    if relation.payload:
        payload = F.struct(*relation.payload)
        if seq:
            payload = F.last(payload).over(Window.partitionBy(*columns).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        j = j.withColumn("_junction", payload)
        columns.append("_junction")
    j = j.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(columns)])
    kept = where(child, _free(relation, conditions))
    own = [c for c in kept.columns if c != relation.left_fk]
    out = j.join(kept, F.col("_j1") == kept[child_key])
    return out.select(F.col("_j0").alias(relation.left_fk), *own, *([F.col("_j2").alias("_junction")] if relation.payload else []))


def temporal_range(relation: Temporal, child: DataFrame, parent_id: Any, low: Any, high: Any = None, conditions: dict[str, Any] | None = None) -> DataFrame:
    """Children of one parent from ``low`` to ``high``, both inclusive; no ``high``: open."""
    out = where(child.where(equals(child, relation.fk, parent_id)), _free(relation, conditions)).where(F.col(relation.at) >= F.lit(low))
    out = out if high is None else out.where(F.col(relation.at) <= F.lit(high))
    return out if relation.cutoff is None else out.withColumn("_archived", F.coalesce(archived(relation), F.lit(True)))


def counts(relation: Relation, rows: DataFrame, conditions: dict[str, Any] | None = None) -> DataFrame:
    """(parent key, n): children, or junction rows of a many-to-many relation."""
    key = relation.left_fk if isinstance(relation, ManyToMany) else relation.id_field if isinstance(relation, Polymorphic) else relation.fk
    return where(rows, _free(relation, conditions)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def aggregated(relation: Relation, rows: DataFrame, measures: dict[str, tuple[str, str | None]], conditions: dict[str, Any] | None = None, decimals: int | None = None) -> DataFrame:
    """Measures by parent. ``rows`` are children, or of a many-to-many relation what ``through`` gives, where sums of nothing are null and avg counts numbers alone."""
    many = isinstance(relation, ManyToMany)
    kept = rows.where(matching(rows, _free(relation, conditions)))
    return kept.groupBy(relation.left_fk if many else relation.fk).agg(*[measure(rows, fn, c, decimals, many).alias(name) for name, (fn, c) in measures.items()])


def load_with(parent: DataFrame, parent_key: str, relations: dict[str, tuple[DataFrame, str, str]], limit: int = 0) -> DataFrame:
    """Parents with an array of children for each relation: ``{name: (children, foreign key, order)}``.

    Children are aggregated before the join. With a limit only the first of
    each parent by ``order`` come along, so that arrays stay small.
    """
    out = parent
    for name, (child, fk, order) in relations.items():
        if limit:
            child = child.withColumn("_n", F.row_number().over(Window.partitionBy(fk).orderBy(order))).where(F.col("_n") <= limit).drop("_n")
        row = F.struct(F.col(order).alias("_o"), *[c for c in child.columns])
        lists = child.groupBy(F.col(fk).alias(f"_{name}_fk")).agg(F.sort_array(F.collect_list(row)).alias(name))
        out = out.join(lists, out[parent_key] == F.col(f"_{name}_fk"), "left").drop(f"_{name}_fk")
        out = out.withColumn(name, F.transform(F.coalesce(F.col(name), F.array()), lambda x: x.dropFields("_o")))
    return out


def orphans(child: DataFrame, fk: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent doesn't exist."""
    return child.join(parent.select(F.col(parent_key).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

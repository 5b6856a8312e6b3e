"""From a log to its live table, versions and statistics.

A log is a frame with an order (``seq``), a key and a tombstone flag. The last
row of each key wins; if it is a tombstone, the key is gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_VERSIONS = 65_535


def live(log: DataFrame, key: str, seq: str, deleted: Column) -> DataFrame:
    """The last row of each key unless it is a tombstone.

    ``max_by`` on the whole row combines on the map side, so a key's history is
    never brought together: one row a key and task is shuffled.
    """
    row = F.struct(*[F.col(c) for c in log.columns], deleted.alias("_gone"))
    last = log.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.col(seq)).alias("_row"))
    return last.where(~F.coalesce(F.col("_row._gone"), F.lit(False))).select(*[F.col(f"_row.{c}").alias(c) for c in log.columns])


def versions(log: DataFrame, key: str, seq: str, deleted: Column, base: Column | None = None) -> DataFrame:
    """Rows that aren't tombstones, with ``version``: their number since the key's last tombstone, up to MOST_VERSIONS.

    ``base`` is a version that a row brings along, as after compaction.
    """
    order = Window.partitionBy(key).orderBy(seq)
    epoch = F.sum(F.coalesce(deleted, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = log.withColumn("_epoch", epoch).where(~F.coalesce(deleted, F.lit(False)))
    within = Window.partitionBy(key, "_epoch").orderBy(seq)
    count = F.row_number().over(within)
    if base is not None:
        count = count + F.coalesce(F.first(base).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)) - 1
    return rows.withColumn("version", F.least(F.lit(MOST_VERSIONS), count).cast("int")).drop("_epoch")


def stats(log: DataFrame, key: str, seq: str, deleted: Column) -> DataFrame:
    """One row: total_lines, deleted_records, active_records; a count by key on the map side, no window."""
    gone = F.coalesce(deleted, F.lit(False))
    each = log.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(gone.cast("bigint")).alias("d"), F.max_by(gone, F.col(seq)).alias("g"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("d"), F.lit(0)).alias("deleted_records"), F.coalesce(F.sum((~F.col("g")).cast("bigint")), F.lit(0)).alias("active_records"))

"""Reading and writing record logs as JSON lines, with or without a guard line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coercion import field_text, has_field

#: Fixed value: the first line of a guarded log.
GUARD = "<?php die(); ?>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, id, deleted, body, record) of each valid line; blank, broken and guard lines are left out.

    ``seq`` sorts like the lines of a file, also where it is read in splits; of
    several files, like their paths. ``record`` is a VARIANT.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    records = lines.where(F.trim("value") != "").where(F.col("value") != GUARD).withColumn("record", F.try_parse_json("value")).where(F.col("record").isNotNull())
    deleted = has_field(F.col("record"), "_deleted") & (field_text(F.col("record"), "_deleted") == "1")
    return records.select(F.struct("file", "at", "n").alias("seq"), field_text(F.col("record"), "id").alias("id"), F.coalesce(deleted, F.lit(False)).alias("deleted"), F.col("value").alias("body"), "record")


def write_jsonl(live: DataFrame, path: str, guard: bool = False) -> None:
    """Bodies as lines of text files; with ``guard`` each task's lines follow a guard line."""
    body = live.select(F.col("body").alias("value"))
    if guard:
        body = body.mapInArrow(_guarded, "value string")
    body.write.mode("errorifexists").text(path)


def _guarded(batches):
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array([GUARD])], ["value"])
    yield from batches

"""A log as a stream: changes applied to a snapshot, batch by batch, and event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.replay import live


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of a Parquet log, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def follow(changes: DataFrame, key: str, seq: str, deleted: str, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key under ``out``, tombstones included, as one folder a batch.

    A batch is combined on the map side before it meets the snapshot. Each batch
    writes a folder of its own and names it last, so a repeated batch gives the
    same state; ``snapshot`` reads the newest.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        was = newest(spark, out, before=n)
        rows = batch if was is None else batch.unionByName(was)
        rows = rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]), F.col(seq)).alias("r")).select("r.*")
        rows.write.mode("overwrite").parquet(f"{out}/batch={n:012d}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = sorted(int(p.getName().split("=")[1]) for p in names)
    numbers = [x for x in numbers if before is None or x < before]
    return spark.read.parquet(f"{out}/batch={numbers[-1]:012d}") if numbers else None


def snapshot(spark: SparkSession, out: str, key: str, seq: str, deleted: str) -> DataFrame:
    """The live table after the newest batch."""
    return live(newest(spark, out), key, seq, F.col(deleted))


def counts_by_time(changes: DataFrame, at: str, by: str, window: str, late: str) -> DataFrame:
    """Rows by group and event-time window; rows later than ``late`` behind the newest are dropped, as those before an archive cutoff are refused."""
    return changes.withWatermark(at, late).groupBy(F.window(at, window), F.col(by)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")

"""Listing and deleting through Hadoop's file systems, so that segments may be anywhere Spark writes."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def delete(self, path: str) -> None:
        """Delete a folder with all that is in it; one that isn't there is no error."""
        system, at = self._at(path)
        system.delete(at, True)

    def glob(self, pattern: str) -> list[str]:
        system, at = self._at(pattern)
        return sorted(s.getPath().toString() for s in system.globStatus(at) or [])


def local(path: str) -> str | None:
    """The local path of a plain or file: path; None for one elsewhere."""
    if path.startswith("file:"):
        return re.sub(r"^file:/*", "/", path)
    return None if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path) else path

"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``. Null texts count
as empty, an empty table stays empty, and rows go only by a stage's decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.common import marked, table, without, written
from driftlog.llm.decontaminate import contaminated
from driftlog.llm.exact_dedup import drop_exact
from driftlog.llm.mixing import mix
from driftlog.llm.near_dedup import near_dedup
from driftlog.llm.quality import good_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as one empty passage; without labels of both
    kinds all stay, as every score is 0.5. Repeated rows and rows without an id fare by their text.
    """
    return good_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    Null and empty texts are equal; a row without an id stays only where no
    equal text has one; of rows equal in id and text one stays.
    """
    return drop_exact(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id: shingles of five words, similarity of 0.8 or more.

    Texts without words stay. Rows equal in id and text fare alike; rows that
    share an id, or have none, are told apart by their text.
    """
    docs = docs.select(*COLUMNS)
    return without(docs, near_dedup(marked(docs), mark_col="mark").where("not kept").select("mark"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go.

    Texts without words stay, and all do where the benchmark is empty; rows are
    told apart as in near.
    """
    docs = docs.select(*COLUMNS)
    return without(docs, contaminated(marked(docs), table(spark, sf_dir, "benchmark"), id_col="mark").select(F.col("doc_id").alias("mark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their share in it.

    Texts without words have size 0 and aren't taken; a null source is a source
    of its own; rows equal in id and text fare alike.
    """
    return mix(docs, carry=("text", "lang", "source", "n_chars")).where("taken > 0")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("mixing", mixing)]
#: The classifier can't be written in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

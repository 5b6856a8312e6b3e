"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash. Tokens are summed by source and hash bucket;
the bucket in which a source's budget runs out is found from running sums, and
only that bucket is refined, by the next bits, until it is one hash value.
Documents below the threshold are taken: a filter, no sort of the documents.
Raising a budget only ever adds documents, so budgets nest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Bits of the hash that each histogram resolves: 60 in all.
LEVELS = (12, 20, 28)
#: Up to so many sources (a row of about 100 bytes each) the thresholds are broadcast; beyond, joined by a shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size).

    Water-filling: shares by weight, held to ``cap`` times the source's size,
    the excess reshared among the others. In order of cap by weight the first
    sources are full; the level of the rest follows from running sums. One row
    a source, in one task.
    """
    n = len(weights)
    by_code_point = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_code_point)
    w = reduce(lambda c, i: c.when(rank % n == (i + 1) % n, weights[i]), range(1, n), F.when(rank % n == 1 % n, weights[0])).cast("double")
    every = Window.partitionBy()
    full_first = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("w", w)
        .withColumn("full_at", F.col("source_size") * F.lit(float(cap)) / F.col("w"))
        .withColumn("left", F.lit(float(share)) * F.sum("source_size").over(every) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.min(F.when(F.col("left") / F.col("w_left") <= F.col("full_at"), F.struct(F.row_number().over(full_first).alias("i"), (F.col("left") / F.col("w_left")).alias("v")))).over(every)["v"])
        .select("key", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("level") * F.col("w"), F.lit(float(cap)) * F.col("source_size"))).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``.

    A source with target T and size S takes all its documents T // S times and
    those below a hash threshold once more; the threshold is where the sum
    comes nearest to the rest of T (within half a document). ``cap`` bounds
    the copies of a document. ``carry`` names further columns to return, as
    they are, in a second reading of ``docs``.

    Null text: size 0, nothing to take. Null source: a source of its own, after
    all others. Rows with the same id and text have the same hash and fare
    alike; empty tables give no rows. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("s"), docs[source_col]), F.lit("n"))
    found = [docs[id_col].alias("doc_id"), key.alias("key"), n_words(docs[text_col]).alias("size"), doc_hash(docs[id_col], docs[text_col]).alias("h")]
    rows = written(docs.select(*found, docs[source_col].alias("source")), "mix-rows")
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    per = written(
        targets(sizes, weights, share, cap)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    few = per.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    # below: tokens of the source's documents under prefix; the threshold lies among those with this prefix.
    bits, open_ = 60, rows.select("key", "size", "h")
    state = per.select("key", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for width in LEVELS:
        bits -= width
        hist = open_.groupBy("key", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("tokens"))
        run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.join(small(state.select("key", "need", "prefix", "below")), "key").withColumn("under", F.col("below") + F.coalesce(F.sum("tokens").over(run), F.lit(0)))
        # The last bucket whose lower edge is within the budget.
        state = written(hist.where("under <= need").groupBy("key").agg(F.max_by(F.struct("need", F.col("bucket").alias("prefix"), F.col("under").alias("below"), "tokens"), "bucket").alias("s")).select("key", "s.*"), f"mix-level{bits}")
        if bits:
            open_ = written(open_.join(small(state.select("key", "prefix")), "key").where(F.shiftright("h", bits) == F.col("prefix")).select("key", "size", "h"), f"mix-open{bits}")
    # The boundary itself counts if that comes nearer.
    edge = state.select("key", (F.col("prefix") + F.when((F.col("need") - F.col("below")) * 2 > F.col("tokens"), 1).otherwise(0)).alias("under"))
    edge = per.select("key", "source_size", "target", "whole").join(edge, "key", "left")
    copies = F.col("whole") + F.when(F.col("h") < F.col("under"), 1).otherwise(0)
    every = docs.select(*found, *[docs[c].alias(f"_{c}") for c in carry]) if carry else rows.select("doc_id", "key", "size", "h")
    return every.join(small(edge), "key").select("doc_id", *[F.col(f"_{c}").alias(c) for c in carry], "size", "source_size", "target", (F.col("size") * F.least(copies, F.lit(int(cap)))).cast("long").alias("taken"))

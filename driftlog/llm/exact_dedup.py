"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size. The distinct blocks are sorted, and
their places are their names: two blocks have the same integer if and only if
they have the same bytes. Then adjacent pairs of names are named in the same
way, level by level, until one name is left for each document. With the length
that name is the document's identity; nothing rests on a hash being free of
collisions, as hashes only deal rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, written

#: Blocks or pairs that make up over this share of the rows are named by a broadcast, of 1 / HOT rows at most.
HOT = 0.002


def _named(rows: DataFrame, key: list[str], name: str, n_rows: int) -> DataFrame:
    """``rows`` with ``key`` replaced by an integer name, the same for equal keys and no others.

    A name is the place of the key in the sorted distinct keys of a partition,
    with the partition's number above it. Keys held by more than HOT of all
    rows, 1 / HOT of them at most, go by broadcast, so that no task gets all
    rows of a frequent block.
    """
    names = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
    names = names.sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id())
    names = written(names, f"{name}-names")
    rest = [c for c in rows.columns if c not in key]
    frequent = names.where(F.col("held") > max(1000, int(n_rows * HOT))).select(*key, F.col("name").alias("hot"))
    marked = rows.join(F.broadcast(frequent), key, "left")
    hot = marked.where("hot is not null").select(*rest, F.col("hot").alias("name"))
    cold = marked.where("hot is null").select(*rest, *key).join(names.select(*key, "name"), key).select(*rest, "name")
    return hot.union(cold)


def identities(docs: DataFrame, block: int = 4096) -> DataFrame:
    """(doc_id, sha, n_bytes, name) of the distinct (doc_id, text) of ``docs`` (doc_id, text not null): equal n_bytes and name if and only if the texts are equal."""
    raw = F.col("text").cast("binary")
    rows = docs.select("doc_id", F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), raw.alias("raw"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_bytes") - 1) / block).cast("int"))))).withColumn("part", F.expr(f"substring(raw, 1 + i * {block}, {block})"))
    n_rows, longest = docs.agg(F.sum(F.ceil(F.greatest(F.lit(1), F.octet_length("text")) / block)), F.max(F.octet_length("text"))).first()
    level = written(_named(rows.select("doc_id", "sha", "n_bytes", "i", "part"), ["part"], "blocks", n_rows or 0), "level0")
    parts, size, done = -(-(longest or 0) // block), block, None
    while parts > 1:
        single = level.where(F.col("n_bytes") <= size)
        done = single if done is None else done.union(single)
        half = F.floor(F.col("i") / 2).cast("int")
        pairs = level.where(F.col("n_bytes") > size).groupBy("doc_id", "sha", "n_bytes", half.alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right"))
        pairs = written(pairs, "pairs")
        level = written(_named(pairs, ["left", "right"], "pairs", n_rows or 0), "level")
        parts, size = -(-parts // 2), size * 2
    level = level.where(F.col("n_bytes") <= size)
    level = level if done is None else done.union(level)
    return level.select("doc_id", "sha", "n_bytes", "name").distinct()


def exact_dedup(docs: DataFrame, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs``.

    Texts are equal if their bytes are; null counts as empty, so null and empty
    texts are one group. Of equal texts the row with the largest doc_id stays;
    of repeated rows (same id and text) one. Null ids come before all others
    and stay only in a group that has no other id. An empty table gives no
    rows; other columns are not read.
    """
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    named = written(identities(own, block), "identities")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["sha"] == b["sha"])
    held = own.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")).groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n"))
    held = written(held.alias("h").join(named.alias("i"), same(held, named)).select("h.doc_id", "h.sha", "n", "n_bytes", "name"), "held")
    groups = written(held.groupBy("n_bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    out = held.join(groups, ["n_bytes", "name"])
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("doc_id", "keep_id", "group_size", (first & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, block: int = 4096) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others, whatever their names) that exact_dedup keeps, as they are.

    Nulls, ties, repeated rows and empty tables are as there; of repeated rows
    that differ in other columns any one stays.
    """
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    fate = exact_dedup(docs, block).groupBy(F.col("doc_id").alias("fate_id"), F.col("text_sha256").alias("fate_sha")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("copies"))
    fate = written(fate.where("not stays or copies > 1"), "fate")
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("own_id"), sha.alias("own_sha"))
    met = rows.join(sized(fate, 160), F.col("own_id").eqNullSafe(F.col("fate_id")) & (F.col("own_sha") == F.col("fate_sha")), "left")
    one = met.where("stays").dropDuplicates(["fate_id", "fate_sha"])  # id and text are all that tells rows apart
    return met.where("fate_sha is null").union(one).select("row.*")

"""Helpers shared by the operators: tables, durable intermediates, word shingles, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of texts for the shingle and mixing operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where the setting is missing, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="driftlog-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Bytes that a side may take in memory to go out by broadcast; a larger one is dealt out with the rows.
BROADCAST_BYTES = 8 << 20


def sized(df: DataFrame, width: int | Column = 32, most: int | None = None) -> DataFrame:
    """``df`` (a written table), for broadcast if its rows of ``width`` bytes together are within BROADCAST_BYTES (and ``most``)."""
    total = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    return F.broadcast(df) if total <= min(BROADCAST_BYTES, BROADCAST_BYTES if most is None else most) else df


def _mark() -> Column:
    return F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``mark``: 64 bits of doc_id and text, as rows may have a null id or share one."""
    return docs.withColumn("mark", _mark())


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others, whatever their names) whose mark isn't in ``gone`` (mark)."""
    gone = written(gone.select(F.col("mark").alias("gone_mark")).distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), _mark().alias("own_mark"))
    return rows.join(sized(gone), F.col("own_mark") == F.col("gone_mark"), "left_anti").select("row.*")


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Hand freed memory back, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def tidy(run):
    """``run`` over the batches of a task, with its memory handed back at the end."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def ascii_lower_words(text: str | bytes | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with only A-Z lower-cased: bytes.lower and bytes.split do exactly this, whatever the bytes."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split() if text else []


class WordHash(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), 32]] = True
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers or more of _BASE and of its inverse modulo 2^64."""
    return _powers(1 << max(20, n.bit_length()))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts (runs of anything but ASCII white space), and the number of words of each.

    A polynomial over the bytes, taken for all words at once from running sums.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    power, inverse = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * power[: len(data)], dtype=np.uint64)])
    count = np.diff(np.searchsorted(start, np.concatenate([np.cumsum(size + 1) - size - 1, [len(data) + 1]])))
    return mix64((total[stop] - total[start]) * inverse[start]), count


_GAP = re.compile(rb"[\x09-\x0d ]")


def hashed_words(texts: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, of texts of any length: about ``limit`` bytes at a time, cut between words."""
    out, count, held, owner, size = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        nonlocal held, owner, size
        if held:
            words, n = word_hashes(held)
            out.append(words)
            np.add.at(count, owner, n)
        held, owner, size = [], [], 0

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + limit)
            stop = gap.start() if gap else len(text)
            if size + stop - at > limit:
                flush()
            held.append(text[at:stop])
            owner.append(i)
            size += stop - at
            at = stop
    flush()
    return np.concatenate(out), count


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one shingle as a whole."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h)


def by_bytes(texts: pa.Array, limit: int = 4 << 20):
    """Slices (start, stop) of a column of strings of about ``limit`` bytes each, one row at least."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


LEFT, MAIN, OTHER, BOTH = 0, 1, 2, 3


def tiles(placed: DataFrame, attributes: DataFrame, columns: list[str], side: int) -> DataFrame:
    """The rows of regions that hold several components, dealt out in tiles of about two times ``side`` rows.

    ``placed`` is (region, node, comp, ...), ``attributes`` is by node; rows are
    (tile, side, node, comp, *columns), sorted by tile within partitions, with
    columns of either. A region of up to
    ``side`` rows is one tile, its rows MAIN (of the largest component) or BOTH.
    Of a larger one, the rows outside the largest component stand on the LEFT,
    all rows on the right (MAIN or OTHER), so that each pair across components
    stands in one tile, twice if both are outside the largest. A row stands in
    as many tiles as the region has sides, which are large for that reason.
    """
    parts = placed.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n_part"))
    several = parts.groupBy("region").agg(F.max_by("comp", F.struct("n_part", "comp")).alias("main"), F.sum("n_part").alias("all_n"), F.max("n_part").alias("main_n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    lefts, rights = F.ceil((F.col("all_n") - F.col("main_n")) / side).cast("int"), F.ceil(F.col("all_n") / side).cast("int")
    several = written(several.select("region", "main", lefts.alias("lefts"), rights.alias("rights")), "regions")
    members = placed.join(several, "region").join(attributes, "node")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    tile, is_main = F.xxhash64("region", "i", "j").alias("tile"), F.col("comp") == F.col("main")
    rest = ["node", "comp", *columns]
    one = members.where("rights = 1").select(F.xxhash64("region").alias("tile"), F.when(is_main, MAIN).otherwise(BOTH).alias("side"), *rest)
    large = members.where("rights > 1")
    left = large.where(~is_main).withColumn("i", at("lefts")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).select(tile, F.lit(LEFT).alias("side"), *rest)
    right = large.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("j", at("rights")).select(tile, F.when(is_main, MAIN).otherwise(OTHER).alias("side"), *rest)
    return by_tile(one.union(left).union(right))


def by_tile(rows: DataFrame) -> DataFrame:
    """Sorted by tile, in as many tasks as a shuffle has: the pairs of a tile take time, not room, so small tasks aren't put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions("tile")


def each_tile(batches, together: int = 1):
    """Record batches of whole tiles from batches sorted by ``tile`` (first column): ``together`` rows or more of small tiles at a time."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        joins = bool(held) and held[-1].column(0)[-1].as_py() == key[0]
        # What is held ends with a tile that may go on; a batch is cut after its last whole tile.
        if len(edge) or (held and not joins):
            cut = int(edge[-1]) if len(edge) else 0
            if sum(x.num_rows for x in held) + cut >= together:
                yield _one_batch([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
                continue
        held.append(batch)
    if held:
        yield _one_batch(held)


def _one_batch(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if p.num_rows]
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def tile_bounds(batch: pa.RecordBatch) -> np.ndarray:
    key = np.asarray(batch.column(0))
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


class Groups:
    """Union-find over few integers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (up := self.up.get(at, at)) != at:
            at = up
        while (up := self.up.get(x, x)) != at:
            self.up[x], x = at, up
        return at

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def needed_rows(passing):
    """Tiles to those of their rows that stand in a pair of ``passing`` (batch, a, b -> (i, js)...)."""

    def run(batches):
        for batch in each_tile(batches):
            at, got = tile_bounds(batch), []
            for a, b in zip(at[:-1], at[1:], strict=True):
                got += [np.append(js, i) for i, js in passing(batch, a, b)]
            if got:
                yield batch.take(pa.array(np.unique(np.concatenate(got))))

    return run


def links_of_tiles(passing, payload: str, meets):
    """Tiles with a payload in each row to links (a, b): pairs of ``passing`` that ``meets``, of components that aren't joined in the tile yet."""

    def run(batches):
        for batch in each_tile(batches):
            at, a, b = tile_bounds(batch), [], []
            values, node, comp = batch.column(payload), np.asarray(batch.column("node")), np.asarray(batch.column("comp")).tolist()
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                groups = Groups()
                for i, js in passing(batch, lo, hi):
                    own = values[int(i)].as_py()
                    for j in js.tolist():
                        if groups.root(comp[i]) != groups.root(comp[j]) and meets(own, values[j].as_py()):
                            groups.join(comp[i], comp[j])
                            a.append(int(node[i]))
                            b.append(int(node[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


#: Edges that a task joins by union-find when those of many tasks are brought together.
FOREST = 250_000


def _local_forest(batches):
    """Union-find over the edges of one task, in bounded blocks: each node linked to the root of its block."""
    groups = Groups()

    def out():
        pairs = [(k, groups.root(k)) for k in groups.up]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            groups.join(a, b)
        if len(groups.up) > 500_000:
            yield out()
            groups.up.clear()
    yield out()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b: long, not null).

    Alternating large-star and small-star rounds over written tables, after a
    union-find inside each task. The loop ends when only stars are left: no
    centre is itself linked to a smaller node, and no node has two; one row a
    round at most comes to the driver. Hubs are pre-aggregated (min) and
    written before they are joined back, so that adaptive execution can split
    the join of a hub; it can't where one side is an aggregate.
    """
    nodes_of = edges.select("a", "b").where("a <> b")
    e = written(nodes_of.mapInArrow(_local_forest, "a long, b long"), f"{name}-forest")
    # What the tasks leave is brought together in tasks of FOREST edges: few are left to the rounds.
    e = written(e.coalesce(-(-e.count() // FOREST) or 1).mapInArrow(_local_forest, "a long, b long"), f"{name}-trees")
    while True:
        centres = e.select("b").distinct().withColumnRenamed("b", "a")
        if e.join(centres, "a", "left_semi").select("a").union(e.groupBy("a").count().where("count > 1").select("a")).isEmpty():
            break
        # Large star: each larger neighbour of u, linked to the smallest of u and its neighbours.
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{name}-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e1 = written(large, f"{name}-large")
        # Small star: smaller neighbours of u and u itself, linked to the smallest.
        down = e1.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lo = written(down.groupBy("a").agg(F.min("b").alias("m")), f"{name}-lo")
        small = down.join(lo, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lo.select("a", F.col("m").alias("b"))).distinct()
        e = written(small, f"{name}-small")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Near duplicates by an LSH forest over MinHash signatures.

Every document has one label in each of several trees: a row of MinHash values.
Documents are sorted by label in each tree. A region is a shared prefix of
SHALLOW values; a region that is too large is taken deeper, each part of it as
far as it must to be small enough, and beyond the full depth dealt out by hash. Within each, the neighbours in sorted order,
which share the longest prefixes, are candidates. Candidates whose signatures
agree too little are put aside; the others are confirmed on full shingle sets.

That first pass joins most of each group. A second pass makes the search whole:
in every region that still holds two or more components, all pairs across
components are compared by signature, in blocks, each pair in the first tree
where it meets, and what passes is confirmed on full sets within the block. So
pairs are never written out, a block yields one link at most for each document
and component, and no cap bounds partners or candidates. A link is missed only if two documents
share no prefix in any tree, or if their signatures agree by far less than
their sets. With 16 trees and 3 values that is about 2e-7 for a similarity of
0.85 and 1e-5 for 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LEFT, MAIN, OTHER, WordHash, ascii_lower_words, by_tile, components, links_of_tiles, mix64, needed_rows, shingle_hashes, sized, tidy, tiles, written

TREES, DEPTH, SHALLOW = 16, 8, 3
#: Regions above this many documents are taken deeper or dealt out in the first pass.
REGION = 256
#: Documents in a side of a tile of the second pass.
SIDE = 2048
#: Standard deviations by which signatures may agree less than the threshold says.
SLACK = 5.0

_SEEDS = mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of 16 bits."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[i : i + 1024, None] * _SEEDS).min(axis=0))
    return (mix64(low) >> np.uint64(48)).astype(">u2")


def _read(width: int, full: bool):
    """Batches of (doc_id, text, ...) to (doc_id, n, fp, signature, ...) or, if full, (fp, shingles)."""
    hashes = WordHash()

    def run(batches):
        for batch in batches:
            ids, n, prints, payload = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                s = shingle_hashes(hashes.array(ascii_lower_words(text.as_py())), width)
                ids.append(doc_id)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                payload.append((s if full else signature(s)).tobytes() if len(s) else None)
            cols = [pa.array(prints, pa.binary()), pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["fp", "shingles"]) if full else pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *cols, *batch.columns[2:]], ["doc_id", "n", "fp", "signature", *batch.schema.names[2:]])

    return run


def _prefix(label: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The label of a prefix and its next value."""
    return mix64(label * np.uint64(0x9E3779B97F4A7C15) + value)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64))


def _roots() -> np.ndarray:
    return mix64(np.arange(TREES, dtype=np.uint64))


def _labels(batches):
    """(node, n, signature) to a row for each tree: the region's label, and the order within the region."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").astype(np.uint64).reshape(-1, TREES, DEPTH)
        region = np.broadcast_to(_roots(), sig.shape[:2])
        for k in range(SHALLOW):
            region = _prefix(region, sig[:, :, k])
        order = np.zeros(sig.shape[:2], np.uint64)  # the next values, as a number that sorts like them
        for k in range(SHALLOW, SHALLOW + 4):
            order = order << np.uint64(16) | sig[:, :, k]
        node, tree = np.repeat(np.asarray(batch.column(0)), TREES), np.tile(np.arange(TREES, dtype=np.int32), len(sig))
        yield pa.RecordBatch.from_arrays([_signed(region), _signed(order ^ np.uint64(1 << 63)), pa.array(node), pa.array(tree)], ["region", "place", "node", "tree"])


def _paths(batches):
    """(tree, place, node, signature) to a row for each depth beyond SHALLOW: the label of the prefix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, rest = np.asarray(batch.column(0)), DEPTH - SHALLOW
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u2").astype(np.uint64).reshape(-1, TREES, DEPTH)[np.arange(len(tree)), tree]
        label, steps = _roots()[tree], []
        for k in range(DEPTH):
            label = _prefix(label, sig[:, k])
            steps += [label] if k >= SHALLOW else []
        each = lambda c: pa.array(np.repeat(np.asarray(batch.column(c)), rest))
        yield pa.RecordBatch.from_arrays([each(1), each(2), each(0), pa.array(np.tile(np.arange(SHALLOW + 1, DEPTH + 1, dtype=np.int32), len(tree))), _signed(np.stack(steps, 1))], ["place", "node", "tree", "depth", "label"])


def _agree(cut: int):
    """Keep the pairs (a, b, sa, sb) whose signatures agree in ``cut`` values or more."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= cut))

    return run


_TILE_ROW = "tile long, side int, node long, comp long, tree int, n long, signature binary"


def _passing(cut: int, percent: int):
    """(batch, a, b) to (i, js), with js from the best agreement down: documents of a tile across components that agree in size and signature, each pair in the first tree where it shares a region."""

    def run(batch: pa.RecordBatch, lo: int, hi: int):
        side, node, comp, n = (np.asarray(batch.column(f))[lo:hi] for f in ("side", "node", "comp", "n"))
        sig = np.frombuffer(b"".join(batch.column("signature").slice(lo, hi - lo).to_pylist()), np.uint16).reshape(hi - lo, TREES, DEPTH)
        tree, right = batch.column("tree")[lo].as_py(), np.flatnonzero(side != LEFT)
        for i in np.flatnonzero((side != MAIN) & (side != OTHER)):
            j = right[(comp[right] != comp[i]) & ((side[right] == MAIN) | (node[right] > node[i]))]
            j = j[np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])]
            same = sig[j] == sig[i]
            agree = same.sum(axis=(1, 2))
            ok = (agree >= cut) & ~same[:, :tree, :SHALLOW].all(axis=2).any(axis=1)
            if ok.any():
                yield lo + int(i), lo + j[ok][np.argsort(-agree[ok], kind="stable")]

    return run


def _meets(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Pairs (a, b, x, y) with sets x and y to those that meet the threshold."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                ok.append(_meets(x.as_py(), y.as_py(), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", mark_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``, and its ``mark`` (a long) if ``mark_col`` is given.

    Documents are linked if 100 * intersection >= percent * union of their
    distinct shingles of ``width`` words; component_id is the smallest doc_id
    reachable over links, and the row with that id is kept. Copies with equal
    sets stand as one class from the start.

    Null, empty and blank texts have no shingles and are linked with nothing;
    a text of fewer words is one shingle. Repeated rows share a component and,
    having the same id, are kept alike. A null id counts as larger than any
    other: component_id is null only if the whole component has none. Texts are
    compared by bytes, UTF-8 or not. An empty table gives no rows; other columns
    are not read.
    """
    count = TREES * DEPTH
    cut = int(count * percent / 100 - SLACK * (count * percent / 100 * (1 - percent / 100)) ** 0.5)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    mark = ["mark"] if mark_col else []
    marked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[mark_col].alias("mark")) if mark_col else own
    rows = written(marked.mapInArrow(tidy(_read(width, False)), "doc_id long, n long, fp binary, signature binary" + ", mark long" * len(mark)), "near-rows")
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("min_doc"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    sigs = classes.select("node", "n", "signature")

    trees = sigs.mapInArrow(tidy(_labels), "region long, place long, node long, tree int")
    held = written(trees.groupBy("region").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "near-held")
    live = written(trees.join(held, "region"), "near-live")
    # Rows of large regions go to the shortest common prefix that REGION or fewer have, or are dealt out under the whole label.
    paths = live.where(F.col("held") > REGION).join(sigs.select("node", "signature"), "node").select("tree", "place", "node", "signature")
    steps = written(paths.mapInArrow(tidy(_paths), "place long, node long, tree int, depth int, label long"), "near-steps")
    held_at = written(steps.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "near-deep")
    fits = F.col("n") <= REGION
    at = steps.join(held_at, "label").groupBy("node", "tree", "place").agg(F.min_by(F.struct("label", "n"), F.when(fits, F.col("depth")).otherwise(100 - F.col("depth"))).alias("s")).select("node", "place", "s.*")
    salt = F.pmod(F.xxhash64("node", "label"), F.ceil(F.col("n") / (REGION // 2)).cast("long"))
    large = at.select(F.when(fits, F.col("label")).otherwise(F.xxhash64("label", salt)).alias("key"), "place", "node")
    small = live.where(F.col("held") <= REGION).select(F.col("region").alias("key"), "place", "node")
    beside = F.lead("node").over(Window.partitionBy("key").orderBy("place", "node"))
    pairs = small.union(large).select(F.col("node").alias("x"), beside.alias("y")).where("y is not null and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sa, sb = sigs.select(F.col("node").alias("a"), F.col("signature").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    first = written(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_agree(cut), "a long, b long"), "near-first")

    def shingles(nodes: DataFrame, name: str) -> DataFrame:
        """(node, shingles), from a second reading of one document of each class."""
        wanted = written(nodes.distinct().join(classes.select("node", "fp", "min_doc"), "node"), f"{name}-wanted")
        ids = wanted.select(F.coalesce("min_doc", F.lit(-(1 << 63))).alias("k")).distinct()
        again = own.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(sized(written(ids, f"{name}-ids")), "k", "left_semi").select("doc_id", "text")
        sets = again.mapInArrow(tidy(_read(width, True)), "fp binary, shingles binary").where("fp is not null").groupBy("fp").agg(F.first("shingles").alias("shingles"))
        return written(sets.join(wanted.select("fp", "node"), "fp").select("node", "shingles"), f"{name}-sets")

    sets = shingles(first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))), "near-first")
    xs, ys = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    links = written(first.join(xs, "a").join(ys, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "near-links")
    joined = written(components(links, "near-joined"), "near-joined")

    # Second pass: regions with several components; all documents against those outside the region's largest component.
    placed = written(live.select("region", "tree", "node").join(joined, "node", "left").select("region", "tree", "node", F.coalesce("component", "node").alias("comp")), "near-placed")
    passing = _passing(cut, percent)
    needed = written(tiles(placed, sigs, ["tree", "n", "signature"], SIDE).mapInArrow(tidy(needed_rows(passing)), _TILE_ROW), "near-needed")
    sets = shingles(needed.select("node"), "near-second")
    whole = by_tile(needed.join(sets, "node").select(*(c.split()[0] for c in _TILE_ROW.split(", ")), "shingles"))
    more = written(whole.mapInArrow(tidy(links_of_tiles(passing, "shingles", lambda x, y: _meets(x, y, percent))), "a long, b long"), "near-more")
    stars = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    final = components(stars.union(more), "near-final")

    group = written(classes.select("fp", "node", "min_doc").join(final, "node", "left").select("fp", "min_doc", F.coalesce("component", "node").alias("component")), "near-groups")
    least = written(group.groupBy("component").agg(F.min("min_doc").alias("component_id")), "near-least")
    by_print = group.join(least, "component").select("fp", "component_id")
    out = rows.select("doc_id", "n", "fp", *mark).join(by_print, "fp", "left")
    whole = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), F.col("doc_id").eqNullSafe(whole).alias("kept"), *mark)

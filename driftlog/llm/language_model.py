"""Language-model scoring with an Elias-Fano n-gram trie.

Counts come from all training texts. Each level of the trie is one sorted
sequence of keys (index of the context in the level above, place of the word
among the successors of the shorter context), Elias-Fano coded and cut into
pieces of bounded size; monotone pointers lead from a context to its
successors; interpolated probabilities and back-off weights are quantised to
eight bits. Pieces are files in the shared folder and are memory-mapped, so a
reader holds no more of the model than the pages it touches.

A word is looked up by successor search among its context's keys. As a word is
stored by its place among the successors of the shorter context, the search for
the longest n-gram starts from where the shorter one was found.

P(w | h) = c(h w) / (C + T) + b(h) P(w | h'), where C is the count of h, T the
number of its successors kept, b(h) = 1 - sum of c / (C + T) over those, and
P(w) = (c + 1) / (N + V + 1). By default all n-grams are kept.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, hashed_words, shared_dir, tidy, written
from .elias_fano import EliasFano

#: Bytes of text for each piece of a level, and tokens that its boundaries are set by.
PIECE_BYTES, PIECE_TOKENS = 24 << 20, 2 << 20
SPLIT_TOKENS = PIECE_TOKENS // 16
#: n-grams of so many words are kept from the given count on: all are.
KEEP = {2: 1, 3: 1}
ORDER = 3
#: log10 of probabilities and back-off weights go from 0 to -SPAN in 256 steps.
SPAN = 12.0
#: The end of a text, as a word that no text can hold.
END = xxhash.xxh3_64_intdigest(b"\n")
#: Entries that a task holds before it hands counts on.
HELD = 2_000_000


# Files -----------------------------------------------------------------------


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file; a repeated task writes the same and takes its place at once."""
    at, table, parts = 0, {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        table[name] = (a.dtype.str, at, len(a))
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
        at += a.nbytes + -a.nbytes % 8
    head = json.dumps(table).encode()
    head += b" " * (-len(head) % 8)
    system, path = _place(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for p in parts:
            out.write(p)
    system.move(own, path)


@lru_cache(4096)
def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; from a remote store through a local copy that has no name any more."""
    system, path = _place(uri)
    if isinstance(system, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as local, system.open_input_stream(path) as src:
            while block := src.read(8 << 20):
                local.write(block)
            local.flush()
            data = np.memmap(local.name, np.uint8, "r")
    size = int(data[:8].view(np.uint64)[0])
    table = json.loads(bytes(data[8 : 8 + size]))
    return {k: np.asarray(data[8 + size + at : 8 + size + at + np.dtype(t).itemsize * n]).view(t) for k, (t, at, n) in table.items()}


# Counts ----------------------------------------------------------------------


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of equal weight together, compressed."""
    lanes = lambda a: a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(lanes(np.diff(keys, prepend=np.uint64(0))) + lanes(counts.astype(np.uint64)))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    wide = lambda part: np.ascontiguousarray(part.reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum(wide(data[: 8 * n]), dtype=np.uint64), wide(data[8 * n :]).astype(np.int64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _counted(streams: Iterator[np.ndarray], bounds: np.ndarray):
    """Keys of one task to rows (shard, blob): counted here first, then cut at ``bounds``."""
    schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])

    def cut(parts):
        keys, counts = _merge(parts)
        at = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
        for s in np.flatnonzero(np.diff(at)):
            blob = _pack(keys[at[s] : at[s + 1]], counts[at[s] : at[s + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], schema=schema)

    parts, held = [], 0
    for keys in streams:
        u, c = np.unique(keys, return_counts=True)
        parts.append((u, c.astype(np.int64)))
        held += len(u)
        if held > HELD:
            parts = [_merge(parts)]
            held = len(parts[0][0])
            if held > HELD * 2 // 3:
                yield from cut(parts)
                parts, held = [], 0
    if parts:
        yield from cut(parts)


def _splits(counts: np.ndarray) -> np.ndarray:
    """Places at which running counts pass multiples of SPLIT_TOKENS; hot places once for each multiple."""
    total = np.cumsum(counts)
    return np.searchsorted(total, np.arange(SPLIT_TOKENS, int(total[-1]) if len(total) else 0, SPLIT_TOKENS), side="left").astype(np.int64)


def _thinned(splits: list[np.ndarray]) -> np.ndarray:
    """Of the splits of all pieces in a row those that are PIECE_TOKENS apart."""
    step = max(1, PIECE_TOKENS // SPLIT_TOKENS)
    return np.concatenate(splits)[step - 1 :: step] if splits else np.zeros(0, np.int64)


# Levels ----------------------------------------------------------------------


def _code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * (255 / SPAN)), 0, 255).astype(np.uint8)


def _log10(code: np.ndarray) -> np.ndarray:
    return code * (-SPAN / 255)


class Words:
    """The first level: hashes of words in order, their place being the word's id, with counts."""

    def __init__(self, pieces: list[tuple[str, int, int]], tokens: int) -> None:
        self.pieces, self.tokens, self.size = pieces, tokens, sum(n for _, _, n in pieces)
        self.shards = len(pieces)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        shard = (hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)
        at = np.searchsorted(shard, np.arange(self.shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(at)):
            path, offset, n = self.pieces[s]
            if n:
                part, known = hashes[at[s] : at[s + 1]], load(path)["hash"]
                i = np.minimum(np.searchsorted(known, part), n - 1)
                out[at[s] : at[s + 1]] = np.where(known[i] == part, i + offset, -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        for path, offset, n in self.pieces:
            a, b = np.searchsorted(ids, [offset, offset + n])
            if a < b:
                out[a:b] = load(path)["count"][ids[a:b] - offset]
        return out

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.size + 1))


class Level:
    """A level of pairs (context, place): ``pieces`` are (path, first key, offset, first own context), in order."""

    def __init__(self, pieces: list[tuple[str, int, int, int]], size: int, radix: int) -> None:
        self.pieces, self.size, self.radix = pieces, size, radix
        self.first = np.array([p[1] for p in pieces], np.uint64)
        self.offset = np.array([p[2] for p in pieces], np.int64)
        self.own = np.array([p[3] for p in pieces], np.int64)

    def _by(self, edges: np.ndarray, x: np.ndarray):
        """Pieces with the slice of the sorted ``x`` that falls to each."""
        at = np.concatenate([[0], np.searchsorted(x, edges[1:]), [len(x)]]) if len(edges) else [0]
        for k in np.flatnonzero(np.diff(at)):
            yield self.pieces[k], load(self.pieces[k][0]), slice(at[k], at[k + 1])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of sorted keys, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for (_, first, offset, _), a, s in self._by(self.first, keys):
            x = keys[s] - np.uint64(first)
            ok = (keys[s] >= first) & (x <= a["last"][0])
            i, found = EliasFano.of(a, "key").successor(np.where(ok, x, 0))
            out[s] = np.where(ok & found, i + offset, -1)
        return out

    def keys(self, index: np.ndarray) -> np.ndarray:
        """Keys at sorted indexes."""
        out = np.zeros(len(index), np.uint64)
        for (_, first, offset, _), a, s in self._by(self.offset, index):
            out[s] = EliasFano.of(a, "key").access(index[s] - offset) + np.uint64(first)
        return out

    def log10(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index))
        for (_, _, offset, _), a, s in self._by(self.offset, index):
            out[s] = _log10(a["code"][index[s] - offset])
        return out

    def counts(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        for (_, _, offset, _), a, s in self._by(self.offset, index):
            i = index[s] - offset
            got = a["count"][i].astype(np.int64)
            if len(a["many"]):
                at = np.minimum(np.searchsorted(a["many"], i), len(a["many"]) - 1)
                got = np.where(a["many"][at] == i, a["many_count"][at], got)
            out[s] = got
        return out

    def pointers(self, contexts: np.ndarray) -> np.ndarray:
        """Index of the first successor of sorted contexts."""
        out = np.zeros(len(contexts), np.int64)
        for (_, _, offset, own), a, s in self._by(self.own, contexts):
            out[s] = EliasFano.of(a, "pointer").access(contexts[s] - own).astype(np.int64) + offset
        return out

    def backoff(self, contexts: np.ndarray) -> np.ndarray:
        """log10 of the back-off weights of sorted contexts."""
        out = np.zeros(len(contexts))
        for (_, _, _, own), a, s in self._by(self.own, contexts):
            out[s] = _log10(a["backoff"][contexts[s] - own])
        return out


def at_sorted(f, x: np.ndarray, none: float = 0) -> np.ndarray:
    """``f`` of sorted distinct values, dealt back to ``x``; ``none`` where x is negative."""
    u, back = np.unique(x, return_inverse=True)
    skip = int(np.searchsorted(u, 0)) if u.dtype.kind == "i" else 0
    got = f(u[skip:])
    return np.concatenate([np.full(skip, none, got.dtype), got])[back]


class Model:
    def __init__(self, words: Words, levels: list[Level], uri: str) -> None:
        self.words, self.levels, self.uri = words, levels, uri

    @staticmethod
    def step(level: Level, context: np.ndarray, place: np.ndarray, score: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs (context, place), -1 where either is unknown: index, its place among the context's successors, and if asked for log10 of its probability (0 if it isn't there) and of the context's back-off weight."""
        index, inner = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        p, back = np.zeros(len(context)), np.zeros(len(context))
        if not level.size:
            return index, inner, p, back
        ok = (context >= 0) & (place >= 0)
        u, where = np.unique(context[ok].astype(np.uint64) * np.uint64(level.radix) + place[ok].astype(np.uint64), return_inverse=True)
        i = level.find(u)
        found = i >= 0
        # Keys are sorted, so their contexts are, and each is asked for once.
        contexts = (u // np.uint64(level.radix)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(u) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(u)))
        starts = np.repeat(level.pointers(contexts[first]), times)
        index[ok], inner[ok] = i[where], np.where(found, i - starts, -1)[where]
        if score:
            logs = np.zeros(len(u))
            logs[found] = level.log10(i[found])
            p[ok], back[ok] = logs[where], np.repeat(level.backoff(contexts[first]), times)[where]
            rest = (context >= 0) & ~ok
            back[rest] = at_sorted(level.backoff, context[rest])
        return index, inner, p, back

    def places(self, ids: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(context, place) of the n-grams of ``order`` that end at each place; -1 where there is none. ``first`` marks the first token of each text."""
        context, place = _before(ids, first), ids
        for level in self.levels[: order - 2]:
            index, place, _, _ = self.step(level, context, place, False)
            context = _before(index, first)
        return context, place

    def log10(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token in its context, and the token's count."""
        counts = at_sorted(self.words.counts, ids)
        p = self.words.log10(counts)
        context, place = _before(ids, first), ids
        for level in self.levels:
            index, place, own, back = self.step(level, context, place, True)
            p = np.where(index >= 0, own, p + back)
            context = _before(index, first)
        return p, counts


def _before(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What stands one place before, -1 at the beginning of a text."""
    out = np.concatenate([[-1], x[:-1]])
    out[first] = -1
    return out


# Building --------------------------------------------------------------------


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, each closed by END, and the number of each text; A-Z lower-cased, by bytes."""
    words, count = hashed_words([b"" if t is None else t.lower() for t in texts.cast(pa.binary()).to_pylist()])
    count += 1
    out = np.full(int(count.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(count) - 1] = False
    out[inner] = words
    return out, count


def _firsts(count: np.ndarray) -> np.ndarray:
    out = np.zeros(int(count.sum()), bool)
    out[(np.cumsum(count) - count)[count > 0]] = True
    return out


def _build_words(train: DataFrame, uri: str, shards: int) -> tuple[Words, np.ndarray]:
    """The first level, and keys (word, place) at which the second is to be cut."""
    bounds = np.array([-(-(s << 32) // shards) << 32 for s in range(1, shards)], np.uint64)  # as Words.ids deals hashes out

    def count(batches):
        yield from _counted((_hashes(b.column(0).slice(i, j - i))[0] for b in batches for i, j in by_bytes(b.column(0))), bounds)

    def merge(key, batches):
        shard, keys, counts = key[0].as_py(), *_merge([_unpack(x.as_py()) for x in batches.column("blob")])
        save(f"{uri}/words-{shard}", {"hash": keys, "count": counts})
        hot = _splits(counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "splits": pa.array([hot.tobytes()], pa.binary())})

    rows = written(train.select("text").mapInArrow(tidy(count), "shard int, blob binary").groupBy("shard").applyInArrow(merge, "shard int, n long, total long, splits binary"), "lm-words")
    got = {r["shard"]: r for r in rows.toLocalIterator()}
    pieces, offset, splits = [], 0, []
    for s in range(shards):
        n = got[s]["n"] if s in got else 0
        pieces.append((f"{uri}/words-{s}", offset, n))
        if n:
            splits.append(np.frombuffer(got[s]["splits"], np.int64) + offset)
        offset += n
    return Words(pieces, sum(r["total"] for r in got.values())), _thinned(splits)


def _cut(splits: np.ndarray, radix: int) -> np.ndarray:
    """Keys to cut a level at: at each context of ``splits``, and within one that is named often, at even places."""
    contexts, times = np.unique(splits, return_counts=True)
    inner = [int(c) * radix + radix * k // int(t) for c, t in zip(contexts, times, strict=True) for k in range(int(t))]
    return np.array(sorted({*inner}), np.uint64)


def _build_level(model: Model, seq: DataFrame, order: int, radix: int, contexts: int, splits: np.ndarray, least: int) -> tuple[Level, np.ndarray, int]:
    """The level of n-grams of ``order``: itself, contexts at which to cut the next, and the most successors of a context."""
    uri, bounds = model.uri, _cut(splits, radix)
    if contexts * radix >= 1 << 63:
        raise ValueError(f"{contexts} contexts of {radix} words don't fit in 63 bits")

    def streams(batches):
        for b in batches:
            for i, j in by_bytes(b.column(0)):
                count = np.asarray(pa.compute.binary_length(b.column(0).slice(i, j - i))).astype(np.int64) // 4
                ids = np.frombuffer(b"".join(b.column(0).slice(i, j - i).to_pylist()), np.int32).astype(np.int64)
                context, place = model.places(ids, _firsts(count), order)
                ok = (context >= 0) & (place >= 0)
                context, place = context[ok], place[ok]
                yield context.astype(np.uint64) * np.uint64(radix) + place.astype(np.uint64)

    def merge(key, batches):
        keys, counts = _merge([_unpack(x.as_py()) for x in batches.column("blob")])
        keys, counts = keys[counts >= least], counts[counts >= least]
        n = len(keys)
        parent = (keys // np.uint64(radix)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if n else np.zeros(0, np.int64)
        held, total = np.diff(np.append(at, n)), np.add.reduceat(counts, at) if n else counts
        edge = lambda k: (int(parent[at[k]]), int(held[k]), int(total[k])) if n else (-1, 0, 0)
        row = {"shard": key[0].as_py(), "n": n, "first_key": int(keys[0]) if n else 0, "most": int(held.max()) if n else 0, "first": edge(0), "last": edge(-1), "splits": _splits(counts).tobytes(), "blob": _pack(keys, counts)}
        return pa.Table.from_pylist([row | {"first": list(row["first"]), "last": list(row["last"])}], schema=pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("first_key", pa.int64()), ("most", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("splits", pa.binary()), ("blob", pa.binary())]))

    counted = seq.select("ids").mapInArrow(tidy(lambda b: _counted(streams(b), bounds)), "shard int, blob binary")
    raw = written(counted.groupBy("shard").applyInArrow(merge, "shard int, n long, first_key long, most long, first array<long>, last array<long>, splits binary, blob binary"), f"lm-{order}")
    rows = [r for r in sorted(raw.drop("blob").collect(), key=lambda r: r["shard"]) if r["n"]]  # one small row a piece
    size, most, offset, last = sum(r["n"] for r in rows), max((r["most"] for r in rows), default=0), {}, {}
    pieces, cuts, edges, at = [], [], {}, 0
    for r in rows:  # contexts that stand in several pieces: their successors and counts together
        for p, t, c in {tuple(r["first"]), tuple(r["last"])}:
            was = edges.get(p, (0, 0))
            edges[p] = (was[0] + t, was[1] + c)
    own = 0
    for k, r in enumerate(rows):
        offset[r["shard"]] = at
        end = r["last"][0] if k + 1 < len(rows) else contexts - 1
        last[r["shard"]] = (own, end)
        pieces.append((f"{uri}/level{order}-{r['shard']}", r["first_key"], at, own))
        cuts.append(np.frombuffer(r["splits"], np.int64) + at)
        own, at = max(own, end + 1), at + r["n"]
    most = max([most, *(t for t, _ in edges.values())])

    def build(batches):
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if shard not in offset:
                    continue
                keys, counts = _unpack(blob.as_py())
                parent, place = (keys // np.uint64(radix)).astype(np.int64), (keys % np.uint64(radix)).astype(np.int64)
                begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
                distinct, t, c = parent[begin], np.diff(np.append(begin, len(keys))), np.add.reduceat(counts, begin)
                for k in {0, len(distinct) - 1}:
                    t[k], c[k] = edges[int(distinct[k])]
                if order == 2:
                    whole, lower = model.words.counts(distinct), model.words.log10(at_sorted(model.words.counts, place))
                else:
                    under = model.levels[-1]
                    whole, word = under.counts(distinct), (under.keys(distinct) % np.uint64(under.radix)).astype(np.int64)
                    if order > 3:
                        raise ValueError("orders up to 3 are built")
                    lower = at_sorted(under.log10, np.repeat(at_sorted(under.pointers, word), np.diff(np.append(begin, len(keys)))) + place)
                back = 1 - c / (whole + t)
                each = np.repeat(np.arange(len(distinct)), np.diff(np.append(begin, len(keys))))
                p = counts / (whole + t)[each] + back[each] * 10.0**lower
                lo, hi = last[shard]
                size_own = max(0, hi - lo + 1)
                weight = np.zeros(size_own, np.uint8)
                mine = (distinct >= lo) & (distinct <= hi)
                weight[distinct[mine] - lo] = _code(np.log10(back[mine]))
                starts = np.searchsorted(parent, np.arange(lo, hi + 1))
                many = np.flatnonzero(counts > 255)
                first, end = int(keys[0]), int(keys[-1] - keys[0])
                save(f"{uri}/level{order}-{shard}", {**EliasFano.build(keys - keys[0], end + 1).arrays("key"), **EliasFano.build(starts, len(keys) + 1).arrays("pointer"), "last": np.array([end], np.uint64), "first": np.array([first], np.uint64), "code": _code(np.log10(p)), "backoff": weight, "count": np.minimum(counts, 255).astype(np.uint8), "many": many, "many_count": counts[many]})
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    raw.select("shard", "blob").repartition(max(1, len(rows)), "shard").mapInArrow(tidy(build), "shard int").count()
    return Level(pieces, size, radix), _thinned(cuts), most


def train(seq_of, texts: DataFrame, n_bytes: int, order: int = ORDER, keep: dict[int, int] = KEEP) -> tuple[Model, DataFrame]:
    """A model of the texts that are not held out; ``seq_of`` makes the table of word ids once the words are known."""
    uri = f"{shared_dir(texts.sparkSession)}/lm-{uuid.uuid4().hex}"
    system, path = _place(uri)
    system.create_dir(path)
    words, splits = _build_words(texts.where("not held_out"), uri, max(1, n_bytes // PIECE_BYTES))
    if words.size >= 1 << 31:
        raise ValueError(f"{words.size} words don't fit in 31 bits")
    model, seq = Model(words, [], uri), written(seq_of(words), "lm-ids")
    learned, radix, contexts = seq.where("not held_out"), max(1, words.size), words.size
    for k in range(2, order + 1):
        level, splits, most = _build_level(model, learned, k, radix, contexts, splits, keep[k])
        model.levels.append(level)
        radix, contexts = max(1, most), level.size
    return model, seq


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", keep: dict[int, int] = KEEP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``, read whole.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held`` are held out; all
    others are learned from. Null and empty texts are one end token; a null id
    is not held out. Repeated rows are learned from as often as they stand and
    score alike; texts are read by bytes, UTF-8 or not; an empty table gives no
    rows. Other columns are not read.
    The model's files stay in the shared folder, as the rows are made from them.
    """
    fold = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % folds == held, F.lit(False))
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), fold.alias("held_out"), docs[text_col].alias("text"))
    n_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def ids_of(words: Words) -> DataFrame:
        def run(batches):
            for b in batches:
                for i, j in by_bytes(b.column(2)):
                    hashes, count = _hashes(b.column(2).slice(i, j - i))
                    ids = at_sorted(words.ids, hashes).astype(np.int32)
                    parts = [p.tobytes() for p in np.split(ids, np.cumsum(count)[:-1])]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(parts, pa.binary())], ["doc_id", "held_out", "ids"])

        return own.mapInArrow(tidy(run), "doc_id long, held_out boolean, ids binary")

    model, seq = train(ids_of, own, n_bytes, order, keep)

    def score(batches):
        for b in batches:
            for i, j in by_bytes(b.column(2)):
                part = b.column(2).slice(i, j - i)
                count = np.asarray(pa.compute.binary_length(part)).astype(np.int64) // 4
                ids = np.frombuffer(b"".join(part.to_pylist()), np.int32).astype(np.int64)
                p, c = model.log10(ids, _firsts(count))
                at = np.cumsum(count) - count
                sums = lambda x: np.add.reduceat(x, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(count), pa.array(sums((c > 0).astype(np.int64))), pa.array(np.full(len(count), model.words.tokens, np.int64)), pa.array(sums(model.words.log10(c))), pa.array(sums(p))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return seq.mapInArrow(tidy(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

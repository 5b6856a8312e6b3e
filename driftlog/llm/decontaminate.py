"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over the documents keeps those that hold any n-gram of the benchmark
and shows in how many each n-gram stands. Rare n-grams, the rarer half of each
item's in any case, are seeds, and the rarest ones of every stretch that would
have none otherwise; where a document has one, the item is aligned with the
words around it.
The local alignment's score tells exact, edited and reordered copies from
chance. Items are taken in blocks of bounded size, a pass over the documents
for each block, so that a large benchmark is never sent out whole.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, tidy, written

GRAM = 4
#: Items sent out at a time, at most.
ITEMS = 20_000
#: A seed stands in this share of the documents or fewer, or is among the rarer half of its item's.
RARE = 1e-4
#: The least alignment score of a copy, as a share of the item's words.
LEAST = 0.4
MATCH, MISMATCH, GAP = 1, -1, -1

_WORD = re.compile(r"\w+")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram at each place."""
    size = len(words) - n + 1
    h = np.full(max(0, size), n, np.uint64)
    for k in range(n if size > 0 else 0):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + size])
    return h


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment of two word sequences, and its end in ``doc``."""
    best, end = 0, 0
    row = np.zeros(len(doc) + 1, np.int64)
    ramp = np.arange(len(doc) + 1, dtype=np.int64) * -GAP
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(doc == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp  # gaps in the item's direction
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def spread(held: np.ndarray, chosen: np.ndarray, size: int) -> np.ndarray:
    """``chosen`` places and more, so that each run of ``size`` places has one: the one with the least ``held``, the last of equals."""
    chosen, start = chosen.copy(), 0
    for stop in [*np.flatnonzero(chosen).tolist(), len(held)]:
        while stop - start >= size:
            start += size - int(held[start : start + size][::-1].argmin())
            chosen[start - 1] = True
        start = stop + 1
    return chosen


def _of(batch_text: pa.Array):
    for t in batch_text:
        yield t.as_py()


def _pass(own: DataFrame, given: list[tuple[int, np.ndarray]], n_docs: int, n: int, least: float) -> DataFrame:
    """Copies of the ``given`` items."""
    per = [np.unique(grams(w, min(n, len(w)))) for _, w in given]
    sizes = sorted({min(n, len(w)) for _, w in given})
    every = np.unique(np.concatenate(per)) if per else np.zeros(0, np.uint64)

    def find(batches):
        words = _Words()
        for batch in batches:
            at_row, hits = [], []
            for row, text in enumerate(_of(batch.column(1))):
                w = words(text)
                met = []
                for size in sizes:
                    g = grams(w, size)
                    at = np.minimum(np.searchsorted(every, g), len(every) - 1)
                    met.append(at[every[at] == g])
                if len(met := np.unique(np.concatenate(met))):
                    at_row.append(row)
                    hits.append(met)
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).take(pa.array(at_row, pa.int64())).columns, pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text", "grams"])

    near = written(own.mapInArrow(tidy(find), "doc_id long, text string, grams array<long>"), "seeded")
    df = np.zeros(len(every), np.int64)
    for row in near.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[row["gram"]] = row["n"]
    bound = max(10, RARE * n_docs)
    seeds: dict[int, list[int]] = defaultdict(list)
    for i, g in enumerate(per):
        held = df[np.searchsorted(every, g)]
        rare = g[(held <= bound) | (held <= np.sort(held)[(len(g) - 1) // 2])]
        # A copy has ``score`` words or more in one run, or one more of them in two with an edit between: a run of ``run`` words.
        words_of = given[i][1]
        size = min(n, len(words_of))
        score = math.ceil(least * len(words_of))
        run = max(size, (score + 2) // 2)
        row = grams(words_of, size)
        for x in np.unique(row[spread(df[np.searchsorted(every, row)], np.isin(row, rare), run - size + 1)]).tolist():
            seeds[x].append(i)
    keys = np.array(sorted(seeds), np.uint64)

    def search(batches):
        words = _Words()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), _of(batch.column(1)), strict=True):
                w = words(text)
                spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for size in sizes:
                    g = grams(w, size)
                    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    for p in np.flatnonzero(keys[at] == g).tolist():
                        for i in seeds[int(g[p])]:
                            reach = len(given[i][1]) * 3 // 2 + 8
                            lo, hi = max(0, p - reach), p + reach
                            if spans[i] and spans[i][-1][1] >= lo:
                                spans[i][-1] = (spans[i][-1][0], hi)
                            else:
                                spans[i].append((lo, hi))
                for i, near in spans.items():
                    item_id, item = given[i]
                    score, end = max((score, lo + end) for lo, hi in near for score, end in [align(item, w[lo:hi])])
                    if score >= least * len(item):
                        out.append((doc_id, item_id, score / len(item), end))
            cols = [*zip(*out, strict=True)] or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "end_word"])

    return near.select("doc_id", "text").mapInArrow(tidy(search), "doc_id long, item_id long, score double, end_word long")


def contaminated(docs: DataFrame, items: DataFrame, n: int = GRAM, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, end_word): the rows of ``docs`` that hold a copy of a test item, with that item.

    ``score`` is the best local alignment (match 1, mismatch and gap -1, over
    lower-cased words) by the item's words, ``least`` or more; ``end_word``
    is the place after the alignment's last word. Items of fewer than ``n`` words are
    sought by the whole of their words. Null and empty texts, of documents or
    items, match nothing; bytes that aren't UTF-8 count as U+FFFD; repeated rows come out once for each row in; an
    empty table on either side gives no rows. Other columns are not read.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.make_valid_utf8(docs[text_col]).alias("text"))
    tests = items.select(items["item_id"].cast("long").alias("item_id"), F.make_valid_utf8(items["text"]).alias("text")).where("text is not null")
    n_docs, blocks = own.count(), max(1, -(-tests.count() // ITEMS))
    words, out = _Words(), None
    for k in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        given = [(r["item_id"], w) for r in block.collect() if len(w := words(r["text"]))]
        if given:
            found = _pass(own, given, n_docs, n, least)
            out = found if out is None else out.union(found)
    return own.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long") if out is None else out

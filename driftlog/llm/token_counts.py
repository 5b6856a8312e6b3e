"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers run one after the other.

* The *splitter* reads character classes and marks where pre-tokens begin. It
  has twelve states. A text block is cut into equal chunks; each chunk is read
  from every state at once, which gives its state map; the maps are composed by
  a parallel prefix scan (log2 of the number of chunks rounds), and that gives
  each chunk's true entry state.
* The *token transducer* reads the bytes of a pre-token. Each transition
  carries the number of tokens it emits: the count of the longer prefix less
  that of the shorter one (0 or below where tokens merge), so a path's sum is
  the pre-token's count. A state holds the longest suffix that can still grow
  into a vocabulary token, with the last token and relative count at each place
  in it: finitely many, compiled when first reached and kept up to a bound.

The last token of every prefix is unique: it is the vocabulary token that
ends there and is compatible with the last token before it, where two tokens
are compatible if byte-pair encoding of their concatenation gives the two.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import by_bytes

# Character classes: letters that may follow an apostrophe have their own.
SEP, LETTER, DIGIT, SPACE, WHITE, APOSTROPHE, OTHER, STMD, R, V, L, E = range(12)
# Splitter states; in START every character begins a pre-token.
START, IN_L, IN_N, IN_P, ONE_SP, ONE_WS, RUN_SP, RUN_WS, APO, APO_R, APO_V, APO_L = range(12)
#: Emissions: a pre-token begins at this character, or at the one before it.
HERE, BEFORE = 1, 2


class Classes:
    """Character class of each code point, asked of the library's own splitter when a character is first met."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, 255, np.uint8)
        for chars, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.table[[ord(c) for c in chars]] = kind
        self.split = ByteLevel(add_prefix_space=False).pre_tokenize_str

    def kind(self, char: str) -> int:
        for before, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER)):
            if len(self.split(before + char)) == 1:
                return kind
        return WHITE

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (new := out == 255).any():
            for code in np.unique(codes[new]).tolist():
                self.table[code] = self.kind(chr(code))
            out = self.table[codes]
        return out


@lru_cache(1)
def classes() -> Classes:
    return Classes()


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    step, emit = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    run_of = {DIGIT: IN_N, APOSTROPHE: APO, OTHER: IN_P, SPACE: ONE_SP, WHITE: ONE_WS}
    fresh = lambda c: run_of.get(c, IN_L)
    joined = lambda c: {DIGIT: IN_N, APOSTROPHE: IN_P, OTHER: IN_P}.get(c, IN_L)
    for s in range(12):
        for c in range(12):
            white, letter = c in (SPACE, WHITE), c not in (SEP, DIGIT, SPACE, WHITE, APOSTROPHE, OTHER)
            late = BEFORE if s in (APO_R, APO_V, APO_L) else 0  # the apostrophe stood alone
            if c == SEP:
                to, out = START, late
            elif s == APO and c in (STMD, R, V, L):
                to, out = {STMD: START, R: APO_R, V: APO_V, L: APO_L}[c], 0
            elif (s, c) in ((APO_R, E), (APO_V, E), (APO_L, L)):
                to, out = START, 0
            elif s in (ONE_SP, ONE_WS, RUN_SP, RUN_WS):
                if white:
                    to, out = RUN_SP if c == SPACE else RUN_WS, 0
                elif s in (ONE_SP, RUN_SP):  # one space before a run belongs to it
                    to, out = joined(c), BEFORE if s == RUN_SP else 0
                else:
                    to, out = fresh(c), HERE | (BEFORE if s == RUN_WS else 0)
            elif s in (IN_L, APO_R, APO_V, APO_L) and letter:
                to, out = IN_L, late
            elif s == IN_N and c == DIGIT:
                to, out = IN_N, 0
            elif s in (IN_P, APO) and c in (APOSTROPHE, OTHER):
                to, out = IN_P, 0
            else:
                to, out = fresh(c), HERE | late
            step[s, c], emit[s, c] = to, out
    return step, emit


STEP, EMIT = _splitter()


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (states x chunks): column i maps a state before chunk 0 to that after chunk i."""
    out, d = maps.copy(), 1
    while d < out.shape[1]:
        out[:, d:] = np.take_along_axis(out[:, d:], out[:, :-d], axis=0)
        d *= 2
    return out


def pretoken_starts(kinds: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Whether a pre-token begins at each character of a block of classes."""
    n = len(kinds)
    m = max(1, -(-n // chunk))
    grid = np.full(m * chunk, SEP, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(m, chunk).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], m, axis=1)
    for j in range(chunk):
        maps = STEP[maps, grid[j]]
        if j % 8 == 7 and len(maps) > 1 and (maps == maps[0]).all():
            maps = maps[:1]  # every chunk has forgotten its entry state
    maps = np.broadcast_to(maps, (12, m)) if len(maps) == 1 else maps
    state = np.concatenate([[START], scan(maps)[START, :-1]]).astype(np.uint8)
    out = np.empty((chunk, m), np.uint8)
    for j in range(chunk):
        out[j] = EMIT[state, grid[j]]
        state = STEP[state, grid[j]]
    out = out.T.reshape(-1)
    begins = (out & HERE).astype(bool)
    begins[:-1] |= (out[1:] & BEFORE) > 0
    return begins[:n]


class TokenTransducer:
    """Counts byte-pair tokens of pre-tokens; see the module's docstring."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        data = json.loads(Path(path).read_text())
        bytes_of = _byte_letters()
        raw = lambda s: bytes(bytes_of[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in data["added_tokens"]]
        special = {*self.special}
        self.vocab = {raw(t) for t in data["model"]["vocab"] if t not in special}
        self.growing = {t[:k] for t in self.vocab for k in range(len(t))}
        self.fits: dict[tuple[bytes | None, bytes], bool] = {}
        self.most = most
        self.bits = max(8, (2 * most).bit_length())
        self.clear()

    def clear(self) -> None:
        """Forget all states; transitions are kept in an open-addressed table of fixed size, keyed by state and byte."""
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.emits = np.zeros(1 << self.bits, np.int16)
        self.held = 0
        self.info = [(b"", (None,), (0,))]
        self.ids = {self.info[0]: 0}

    def encode(self, text: bytes) -> list[bytes]:
        """Plain byte-pair encoding, for short texts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (pair := (parts[best], parts[best + 1])) not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fit(self, last: bytes | None, token: bytes) -> bool:
        if (known := self.fits.get((last, token))) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[last, token] = self.encode((last or b"") + token) == ([token] if last is None else [last, token])
        return known

    def advance(self, info: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte, and what the transition emits."""
        suffix, last, rel = info
        suffix += bytes((byte,))
        k = next(k for k in range(len(suffix)) if suffix[k:] in self.vocab and self.fit(last[k], suffix[k:]))
        emits = rel[k] + 1
        last, rel = (*last, suffix[k:]), (*(r - emits for r in rel), 0)
        k = next(k for k in range(len(suffix) + 1) if suffix[k:] in self.growing)
        suffix, last, rel = suffix[k:], last[k:], rel[k:]
        live = [suffix[i:] in self.growing for i in range(len(last))]  # no token can begin at the others
        return (suffix, tuple(x if y else b"" for x, y in zip(last, live, strict=True)), tuple(x if y else 0 for x, y in zip(rel, live, strict=True))), emits

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slots of transitions; where one isn't compiled, the empty slot that ends its probe."""
        mask = (1 << self.bits) - 1
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.keys[slot]
        on = np.flatnonzero((at != key) & (at >= 0))
        while len(on):
            slot[on] = to = (slot[on] + 1) & mask
            at = self.keys[to]
            on = on[(at != key[on]) & (at >= 0)]
        return slot

    def compile(self, key: int) -> bool:
        """Add the transition of state and byte ``key``; False where there is no room."""
        info, emits = self.advance(self.info[key >> 8], key & 255)
        to = self.ids.get(info)
        if self.held >= len(self.keys) * 3 // 4 or to is None and len(self.info) >= self.most:
            return False
        if to is None:
            to = self.ids[info] = len(self.info)
            self.info.append(info)
        slot = int(self.find(np.array([key]))[0])
        self.keys[slot], self.next[slot], self.emits[slot] = key, to, emits
        self.held += 1
        return True

    def walk(self, state: int, tail: bytes) -> int:
        """What is emitted from ``state`` over ``tail``, byte by byte; states that find no room are not kept."""
        total, info, mask = 0, None, (1 << self.bits) - 1
        for byte in tail:
            if info is None:
                key = state << 8 | byte
                slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
                while (at := self.keys[slot]) != key and at >= 0:
                    slot = (slot + 1) & mask
                if at == key or self.compile(key):
                    total += int(self.emits[slot])
                    state = int(self.next[slot])
                    continue
            info, emits = self.advance(info or self.info[state], byte)
            total += emits
        return total

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token ``data[start:start + size]``; all step through the transducer side by side."""
        if len(self.info) > self.most * 7 // 8 or self.held > len(self.keys) * 5 // 8:
            self.clear()
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        longest = int(size[0]) if len(size) else 0
        alive = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
        alone = np.zeros(len(size), bool)  # lanes that have left the table, or outlast nearly all others

        def finish(i: int, j: int) -> None:
            alone[i] = True
            total[i] += self.walk(int(state[i]), data[start[i] + j : start[i] + size[i]].tobytes())

        for j in range(longest):
            m = int(alive[j])
            if m <= 8 and j:
                for i in np.flatnonzero(~alone[:m]):
                    finish(int(i), j)
                break
            key = (state[:m] << 8) | data[start[:m] + j]
            slot = self.find(key)
            if (missing := (self.keys[slot] < 0) & ~alone[:m]).any():
                full = [k for k in np.unique(key[missing]).tolist() if not self.compile(k)]
                if full:
                    for i in np.flatnonzero(missing & np.isin(key, full)):
                        finish(int(i), j)
                slot = self.find(key)
            go = ~alone[:m]
            total[:m] += np.where(go, self.emits[slot], 0)
            state[:m] = np.where(go, self.next[slot], 0)
        out = np.empty_like(total)
        out[order] = total
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in {*own}]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def transducer(path: str) -> TokenTransducer:
    return TokenTransducer(path)


def count_tokens(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text; a special token's string inside a text is one token, as the library has it by default."""
    machine = transducer(path)
    parts: list[str] = []
    owner: list[int] = []
    out = np.zeros(len(texts), np.int64)
    cut = regex.compile("|".join(regex.escape(s) for s in machine.special)) if machine.special else None
    for i, text in enumerate(texts):
        pieces = cut.split(text) if text and cut else [text or ""]
        out[i] += len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    joined = "\n".join(parts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return out
    lengths = np.array([len(p) for p in parts], np.int64)
    kinds = classes()(codes)
    seams = np.cumsum(lengths + 1)[:-1] - 1
    kinds[seams] = SEP
    begins = pretoken_starts(kinds)
    at = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))
    at = np.concatenate([[0], at])
    stops = begins.copy()
    stops[seams] = True
    stops = np.append(np.flatnonzero(stops), len(codes))
    first = np.flatnonzero(np.append(begins, False)[stops[:-1]]) if len(stops) > 1 else np.empty(0, np.int64)
    where = stops[first]
    data = np.frombuffer(joined.encode("utf-8"), np.uint8)
    got = machine.counts(data, at[where], at[stops[first + 1]] - at[where])
    part = np.searchsorted(seams, where)
    np.add.at(out, np.asarray(owner)[part], got)
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, read whole; no shuffle.

    Null and empty texts have 0 bytes and 0 tokens; bytes that aren't UTF-8
    count as U+FFFD. Rows are taken as they
    are: repeated rows and null ids come out once for each row in. Other
    columns are not read. ``tokenizer`` is a path each executor can open.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in by_bytes(texts):
                part = texts.slice(a, b - a)
                n = count_tokens(part.to_pylist(), tokenizer)
                size = pa.compute.fill_null(pa.compute.binary_length(part), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), size, pa.array(n), pa.array(n > limit)], schema=schema)

    return docs.select(docs[id_col].alias("doc_id"), F.make_valid_utf8(docs[text_col]).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Elias-Fano sequences over NumPy arrays, with access and search for many places at a time."""

from __future__ import annotations

import numpy as np

_BYTES = np.arange(256, dtype=np.uint8)
_POP = np.bitwise_count(_BYTES).astype(np.int64)
#: Place of the k-th one in a byte.
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.int64)
_BLOCK = 8  # words of the upper bits for each entry of the directory


class EliasFano:
    """A sorted sequence of unsigned integers below ``universe``: about 2 + log2(universe / n) bits a value."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        upper = (values >> np.uint64(width)).astype(np.int64)
        size = n + (int(universe) >> width) + 1
        bits = np.zeros(-(-size // (64 * _BLOCK)) * 64 * _BLOCK, np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        shifts, parts = np.arange(width, dtype=np.uint64), []
        for at in range(0, n, 65_536):  # a whole number of words each
            part = values[at : at + 65_536, None] >> shifts & np.uint64(1)
            parts.append(np.packbits(part.astype(np.uint8).reshape(-1), bitorder="little"))
        low = np.concatenate(parts) if parts and width else np.zeros(0, np.uint8)
        low = np.concatenate([low, np.zeros(16 + -len(low) % 8, np.uint8)]).view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))])
        return cls(n, width, low, high, ones)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.width], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = arrays[f"{name}.meta"].tolist()
        return cls(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one or zero of the upper bits."""
        if one:
            directory = self.ones
        else:
            if self.zeros is None:
                self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 * _BLOCK - self.ones
            directory = self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        rest = k - directory[block]
        word = block * _BLOCK
        on = np.ones(len(k), bool)
        flip = np.uint64(0) if one else ~np.uint64(0)
        for _ in range(_BLOCK - 1):
            held = np.bitwise_count(self.high[word] ^ flip).astype(np.int64)
            on &= rest >= held
            if not on.any():
                break
            rest -= np.where(on, held, 0)
            word += on
        bits = self.high[word] ^ flip
        shift, on = np.zeros(len(k), np.int64), np.ones(len(k), bool)
        for _ in range(7):
            held = _POP[(bits >> shift.astype(np.uint64) & np.uint64(255)).astype(np.int64)]
            on &= rest >= held
            if not on.any():
                break
            rest -= np.where(on, held, 0)
            shift += 8 * on
        return word * 64 + shift + _SELECT[(bits >> shift.astype(np.uint64) & np.uint64(255)).astype(np.int64), rest]

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, off = at >> 6, (at & 63).astype(np.uint64)
        got = self.low[word] >> off | self.low[word + 1] << np.uint64(1) << (np.uint64(63) - off)
        return got & np.uint64((1 << self.width) - 1)

    def _run(self, at: np.ndarray) -> np.ndarray:
        """Number of ones in a row from the places ``at`` of the upper bits on."""
        out, on, word, off = np.zeros(len(at), np.int64), np.arange(len(at)), at >> 6, at & 63
        while len(on):
            rest = ~(self.high[word] >> off.astype(np.uint64))
            run = np.minimum(np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64), 64 - off)
            out[on] += run
            more = run == 64 - off
            on, word = on[more], word[more] + 1
            off = np.zeros(len(on), np.int64)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        i = np.asarray(i, np.int64)
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width) | self._lower(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that is ``x`` or more, for x below the universe, and whether it is ``x``."""
        x = np.asarray(x, np.uint64)
        h, target = (x >> np.uint64(self.width)).astype(np.int64), x & np.uint64((1 << self.width) - 1)
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1, 0)  # where the ones of this upper part begin
        lo = at - h
        stop = lo + self._run(at)
        hi, on = stop.copy(), np.flatnonzero(lo < stop)
        while len(on):
            a, b = lo[on], hi[on]
            mid = (a + b) >> 1
            less = self._lower(mid) < target[on]
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            lo[on], hi[on] = a, b
            on = on[a < b]
        inside = lo < stop
        return lo, inside & (self._lower(np.where(inside, lo, 0)) == target)

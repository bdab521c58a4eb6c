"""Elias-Fano coded sets of sorted integers, held as two byte arrays.

A sorted value v < universe is split: the low bits are packed side by side, the high part is written
in unary as one bit vector (bit ``high + index`` is set). About ``2 + log2(universe / n)`` bits a key.
Probes are successor searches: a sampled select-0 directory finds the run of keys that share the
probe's high part, a binary search over the packed low bits finds the first key not below the probe.

Codes are written, read and merged block by block: beside the codes themselves only a block of keys is
ever held as numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BLOCK = 64  # bytes of the upper bit vector per directory entry
_CHUNK = 4096  # probes looked at together
_KEYS = 1 << 15  # keys packed together, a multiple of 8
_BYTES = 1 << 13  # bytes of the upper bit vector decoded together


class EliasFano:
    def __init__(self, values: np.ndarray, universe_bits: int):
        """``values``: sorted, distinct, in [0, 2**universe_bits), universe_bits <= 63."""
        v = np.asarray(values, dtype=np.uint64)
        self._write(len(v), universe_bits, [v])

    @classmethod
    def of_blocks(cls, n: int, universe_bits: int, blocks: Iterable[np.ndarray]) -> EliasFano:
        """From ``n`` values in sorted blocks."""
        self = cls.__new__(cls)
        self._write(n, universe_bits, blocks)
        return self

    def _write(self, n: int, universe_bits: int, blocks: Iterable[np.ndarray]) -> None:
        self.n, self.bits = n, universe_bits
        self.low = max(0, universe_bits - max(1, int(n).bit_length()))
        self.upper = np.zeros(((n + (1 << (universe_bits - self.low)) + 1) // (8 * _BLOCK) + 1) * _BLOCK, np.uint8)
        self.lower = np.zeros((n * self.low + 7) // 8 + 16, np.uint8)
        done, rest = 0, np.zeros(0, np.uint64)
        for block in blocks:
            rest = np.concatenate((rest, block)) if len(rest) else block
            whole = len(rest) - len(rest) % 8  # so that the low bits of a block begin at a byte
            for s in range(0, whole, _KEYS):
                done = self._put(done, rest[s : min(whole, s + _KEYS)])
            rest = rest[whole:]
        done = self._put(done, rest)
        if done != n:
            raise ValueError(f"{done} values, {n} announced")
        self._directory()

    def _put(self, at: int, v: np.ndarray) -> int:
        if len(v):
            place = (v >> np.uint64(self.low)).astype(np.int64) + np.arange(at, at + len(v))
            np.add.at(self.upper, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
            if self.low:
                bits = (v[:, None] >> np.arange(self.low, dtype=np.uint64)).astype(np.uint8) & np.uint8(1)
                packed = np.packbits(bits.ravel(), bitorder="little")
                start = at * self.low // 8
                self.lower[start : start + len(packed)] = packed
        return at + len(v)

    def _directory(self) -> None:
        blocks = self.upper.reshape(-1, _BLOCK)
        ones = np.bitwise_count(blocks).sum(axis=1, dtype=np.int64)
        self.zeros_before = np.concatenate(([0], np.cumsum(8 * _BLOCK - ones)))

    @property
    def nbytes(self) -> int:
        return len(self.upper) + len(self.lower) + 8 * len(self.zeros_before)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.bits, len(self.upper)], np.int64).tobytes()
        return head + self.upper.tobytes() + self.lower.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        self = cls.__new__(cls)
        self.n, self.bits, size = np.frombuffer(data[:24], np.int64).tolist()
        self.low = max(0, self.bits - max(1, int(self.n).bit_length()))
        self.upper = np.frombuffer(data[24 : 24 + size], np.uint8)
        self.lower = np.frombuffer(data[24 + size :], np.uint8)
        self._directory()
        return self

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        """Packed low bits of the keys with index ``i``."""
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        at = bit >> 3
        word = np.zeros(len(i), np.uint64)
        for k in range(8):
            word |= self.lower[at + k].astype(np.uint64) << np.uint64(8 * k)
        shift = (bit & 7).astype(np.uint64)
        word >>= shift
        over = shift > 0
        word[over] |= self.lower[at[over] + 8].astype(np.uint64) << (np.uint64(64) - shift[over])
        return word & np.uint64((1 << self.low) - 1)

    def blocks(self) -> Iterator[np.ndarray]:
        """The values in order, a block at a time."""
        at = 0
        for s in range(0, len(self.upper), _BYTES):
            ones = np.flatnonzero(np.unpackbits(self.upper[s : s + _BYTES], bitorder="little"))
            if len(ones):
                i = np.arange(at, at + len(ones))
                at += len(ones)
                yield ((ones + 8 * s - i).astype(np.uint64) << np.uint64(self.low)) | self._low_at(i)

    def decode(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *self.blocks()])

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the upper bits."""
        block = np.searchsorted(self.zeros_before, k, side="right") - 1
        rest = k - self.zeros_before[block]
        bits = np.unpackbits(self.upper.reshape(-1, _BLOCK)[block], axis=1, bitorder="little")
        seen = np.cumsum(1 - bits, axis=1, dtype=np.int16)
        return block * 8 * _BLOCK + np.argmax(seen > rest[:, None], axis=1)

    def successor_index(self, probes: np.ndarray) -> np.ndarray:
        """Index of the first key >= probe; n where there is none."""
        x = np.asarray(probes, dtype=np.uint64)
        out = np.empty(len(x), np.int64)
        for s in range(0, len(x), _CHUNK):
            p = x[s : s + _CHUNK]
            high = (p >> np.uint64(self.low)).astype(np.int64)
            low = p & np.uint64((1 << self.low) - 1)
            after = self._select0(high) - high  # keys whose high part is <= the probe's
            lo = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) - np.maximum(high - 1, 0), 0)
            hi = after.copy()
            while np.any(open_ := lo < hi):
                mid = (lo + hi) >> 1
                less = np.zeros(len(p), bool)
                less[open_] = self._low_at(mid[open_]) < low[open_]
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
            out[s : s + _CHUNK] = lo
        return out

    def key_at(self, index: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low_at(index)

    def contains(self, probes: np.ndarray) -> np.ndarray:
        x = np.asarray(probes, dtype=np.uint64)
        out = np.zeros(len(x), bool)
        if not self.n:
            return out
        for s in range(0, len(x), _CHUNK):
            p = x[s : s + _CHUNK]
            i = self.successor_index(p)
            high = (p >> np.uint64(self.low)).astype(np.int64)
            inside = i < self._select0(high) - high  # the successor shares the high part
            hit = np.zeros(len(p), bool)
            hit[inside] = self._low_at(i[inside]) == (p[inside] & np.uint64((1 << self.low) - 1))
            out[s : s + _CHUNK] = hit
        return out

    def merge(self, new: np.ndarray) -> EliasFano:
        """The set with the sorted, distinct ``new`` added (none of them in it): one sequential merge."""
        return EliasFano.of_blocks(self.n + len(new), self.bits, self._merged(np.asarray(new, np.uint64))) if len(new) else self

    def _merged(self, new: np.ndarray) -> Iterator[np.ndarray]:
        at = 0
        for block in self.blocks():
            to = int(np.searchsorted(new, block[-1]))
            if to > at:
                block = np.concatenate((block, new[at:to]))
                block.sort(kind="stable")  # two sorted runs: a single merge
                at = to
            yield block
        for s in range(at, len(new), _KEYS):
            yield new[s : s + _KEYS]

"""Elias-Fano coding of ascending numbers, with select."""

from __future__ import annotations

import struct

import numpy as np

#: One position is stored for so many set bits.
SAMPLE = 512
HEAD = struct.Struct("<QQB7x")


class EliasFano:
    """``n`` non-decreasing numbers up to ``universe`` in about ``n * (2 + log2(universe / n))`` bits.

    The lower bits of each number stand packed one after another; the upper parts
    are set bits at ``(value >> low) + index``. Select of a set bit starts at the
    nearest stored position and counts words from there.
    """

    def __init__(self, data: bytes | memoryview) -> None:
        self.n, self.universe, self.low = HEAD.unpack_from(data)
        low_bytes, words, samples = self._sizes(self.n, self.universe, self.low)
        at = HEAD.size
        self.lows = np.frombuffer(data, np.uint8, low_bytes, at)
        self.words = np.frombuffer(data, "<u8", words, at + low_bytes)
        self.samples = np.frombuffer(data, "<u4", samples, at + low_bytes + 8 * words)
        self.nbytes = at + low_bytes + 8 * words + 4 * samples

    @staticmethod
    def _sizes(n: int, universe: int, low: int) -> tuple[int, int, int]:
        return (n * low + 7) // 8, (n + (universe >> low) + 1 + 63) // 64, -(-n // SAMPLE)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        low_bytes, words, _ = cls._sizes(n, universe, low)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper = np.zeros(words * 64, np.uint8)
        upper[high] = 1
        lows = np.packbits(bits, bitorder="little").tobytes().ljust(low_bytes, b"\0")
        return HEAD.pack(n, universe, low) + lows + np.packbits(upper, bitorder="little").tobytes() + high[::SAMPLE].astype("<u4").tobytes()

    def _low(self, i: int) -> int:
        a, b = i * self.low, (i + 1) * self.low
        return int.from_bytes(self.lows[a // 8 : (b + 7) // 8].tobytes(), "little") >> a % 8 & (1 << self.low) - 1

    def select(self, i: int) -> int:
        """The ``i``-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        word, need = at // 64, i % SAMPLE
        bits = int(self.words[word]) >> at % 64 << at % 64
        while (have := bits.bit_count()) <= need:
            need, word = need - have, word + 1
            bits = int(self.words[word])
        for _ in range(need):
            bits &= bits - 1
        return (64 * word + (bits & -bits).bit_length() - 1 - i) << self.low | self._low(i)

    def to_array(self) -> np.ndarray:
        """All numbers."""
        high = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little")) - np.arange(self.n)
        bits = np.unpackbits(self.lows, bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
        lows = (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (high.astype(np.uint64) << np.uint64(self.low)) + lows

"""Elias-Fano sequences in numpy, read in place from memory-mapped files."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: A one, and the highest bit, in each byte.
_EACH, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_BITS = np.arange(256)[:, None] >> np.arange(8) & 1
#: Place of the k-th set bit of a byte at 8 * byte + k.
_PLACES = np.array([[*np.flatnonzero(row), *[0] * (8 - row.sum())] for row in _BITS], np.int64).ravel()
#: Numbers whose low bits are laid out at once; a multiple of 64.
_BLOCK = 1 << 16


def _packed(low: np.ndarray, bits: int) -> np.ndarray:
    """The lowest `bits` bits of each number one after another, in 64-bit words, and a word to spare."""
    parts = [np.zeros(0, np.uint64)]
    for at in range(0, len(low) if bits else 0, _BLOCK):
        flat = ((low[at : at + _BLOCK, None] >> np.arange(bits, dtype=np.uint64)) & _ONE).astype(np.uint8).ravel()
        parts.append(np.packbits(np.pad(flat, (0, -len(flat) % 64)), bitorder="little").view("<u8"))
    return np.concatenate([*parts, np.zeros(1, np.uint64)])


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold a sequence of whole numbers, none less than the one before: low bits packed, high bits in unary, and how many ones and zeros
    stand before each 64-bit word of these."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    high = values >> np.uint64(bits)
    size = n + (int(high[-1]) if n else 0) + 1
    flags = np.zeros(size + -size % 64, np.uint8)
    flags[(high + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
    words = np.packbits(flags, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
    zeros = 64 * np.arange(len(words)) - ones
    kind = np.uint32 if len(flags) < 1 << 32 else np.uint64
    return {"meta": np.array([n, bits, top], np.uint64), "low": _packed(values & np.uint64((1 << bits) - 1), bits), "high": words, "ones": ones.astype(kind), "zeros": zeros.astype(kind)}


def _select_in(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit of each word that `rank` set bits precede: running counts of the bytes' bits, in the bytes of one product, give the
    byte, a table the bit."""
    words, rank = np.ascontiguousarray(words), rank.astype(np.uint64)
    upto = np.bitwise_count(words.view(np.uint8)).view(np.uint64) * _EACH
    byte = np.bitwise_count(((rank * _EACH | _HIGHS) - upto) & _HIGHS).astype(np.uint64) << np.uint64(3)
    before = (upto << np.uint64(8)) >> byte & np.uint64(255)
    own = words >> byte & np.uint64(255)
    return byte.astype(np.int64) + _PLACES[(own << np.uint64(3) | rank - before).astype(np.int64)]


class EliasFano:
    """An encoded sequence; all calls take and give arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits, self.top = (int(x) for x in arrays["meta"])
        self.low, self.high, self.ones, self.zeros = arrays["low"], arrays["high"], arrays["ones"], arrays["zeros"]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(off, _ONE)), np.uint64(0))
        return ((self.low[word] >> off) | upper) & np.uint64((1 << self.bits) - 1)

    def _select(self, before: np.ndarray, words: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        at = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        found = words[at]
        return 64 * at + _select_in(~found if flip else found, k - before[at].astype(np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        high = self._select(self.ones, self.high, i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._lows(i)

    def _run(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the places whose numbers have these high bits: what stands behind the zero before, and the ones that follow there."""
        at = np.zeros(len(high), np.int64)
        some = high > 0
        at[some] = self._select(self.zeros, self.high, high[some] - 1, True) + 1
        start, word, off = at - high, at >> 6, (at & 63).astype(np.uint64)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)]
        window = self.high[np.minimum(word, len(self.high) - 1)] >> off | np.where(off > 0, after << (np.uint64(64) - np.maximum(off, _ONE)), np.uint64(0))
        ones = np.bitwise_count(window ^ (window + _ONE)).astype(np.int64) - 1
        end = start + ones
        long = np.flatnonzero(ones >= 63 - off.astype(np.int64) * (word + 1 >= len(self.high)))
        if len(long):  # runs that may go on beyond
            end[long] = self._select(self.zeros, self.high, high[long], True) - high[long]
        return start, end

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, equal): among places lo <= place < hi the first whose number is x or more, hi if there is none, and whether it is x."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return hi.copy(), np.zeros(len(x), bool)
        most = self.top >> self.bits
        high = np.minimum(x >> np.uint64(self.bits), np.uint64(most + 1)).astype(np.int64)
        inside = high <= most
        start = np.where(inside, 0, self.n)
        end = start.copy()
        start[inside], end[inside] = self._run(high[inside])
        start, end = np.clip(start, lo, hi), np.clip(end, lo, hi)
        last, low = end.copy(), x & np.uint64((1 << self.bits) - 1)
        while True:
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                break
            middle = (start[open_] + end[open_]) // 2
            less = self._lows(middle) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            end[open_] = np.where(less, end[open_], middle)
        equal = start < last
        at = np.flatnonzero(equal)
        equal[at] = self._lows(start[at]) == low[at]
        return start, equal

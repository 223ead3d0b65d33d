"""Elias-Fano sequences over flat byte arrays, read by whole vectors of queries."""

from __future__ import annotations

import numpy as np

def pack(parts: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one blob, each at a multiple of 8 bytes, behind their directory."""
    head, body, at = [], [], 0
    for name, a in parts.items():
        raw = np.ascontiguousarray(a).tobytes()
        head.append(f"{name} {a.dtype.str} {at} {a.size}")
        body.append(raw + bytes(-len(raw) % 8))
        at += len(body[-1])
    top = "\n".join(head).encode()
    top += b" " * (-(len(top) + 8) % 8)
    return len(top).to_bytes(8, "little") + top + b"".join(body)


def unpack(blob: np.ndarray) -> dict[str, np.ndarray]:
    """Views into a blob (a memory map is not read until its pages are)."""
    n = int(blob[:8].view("<u8")[0])
    out = {}
    for line in blob[8 : 8 + n].tobytes().decode().strip().split("\n"):
        name, dtype, at, size = line.split()
        start = 8 + n + int(at)
        out[name] = blob[start : start + int(size) * np.dtype(dtype).itemsize].view(dtype)
    return out


_U = np.uint64
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the rank-th set bit of a byte, at rank * 256 + byte (7 if there is none).
_IN_BYTE = np.array([next((p for p in range(8) if x >> p & 1 and (x & ((1 << p) - 1)).bit_count() == r), 7) for r in range(8) for x in range(256)], np.uint8)


def _select_in_words(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th set bit of each 64-bit word, which must have so many: bytes' sums find its byte, a table its bit."""
    rank = rank.astype(_U)
    sums = words - ((words >> _U(1)) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
    sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # set bits up to each byte
    # bytes whose bits up to them are at most rank come before
    before = np.bitwise_count(((rank * _EACH | _TOPS) - sums) & _TOPS).astype(_U) << _U(3)
    inside = rank - ((sums << _U(8)) >> before & _U(255))
    return (before + _IN_BYTE[(inside << _U(8)) | (words >> before & _U(255))]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary.

    ``dir`` has the ones before each 64-bit word of the unary part, for rank and select.
    """

    def __init__(self, parts: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = (int(x) for x in parts[f"{name}.meta"])
        self.low, self.high, self.dir = parts[f"{name}.low"], parts[f"{name}.high"], parts[f"{name}.dir"]
        # 8-byte reads at any byte
        self.window = np.ndarray(max(0, len(self.low) - 7), "<u8", self.low, strides=(1,)) if len(self.low) else None
        self.zeros = np.arange(len(self.dir), dtype=np.int64) * 64 - self.dir

    @staticmethod
    def build(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        words = np.zeros((int(high[-1]) if n else 0) // 64 + 2, np.uint64)  # a closing zero always follows
        np.bitwise_or.at(words, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
        ones = np.zeros(len(words), np.int64)
        ones[1:] = np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]
        low = np.zeros(n * low_bits // 8 + 16, np.uint8) if low_bits else np.zeros(0, np.uint8)
        if low_bits:
            bits = v & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            for b in range(low_bits):
                put = at + b
                np.bitwise_or.at(low, put >> 3, ((bits >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) << (put & 7).astype(np.uint8))
        return {f"{name}.meta": np.array([n, low_bits], np.int64), f"{name}.low": low, f"{name}.high": words, f"{name}.dir": ones.astype(np.uint32)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        # a value that doesn't fit the 8 bytes from its first one would need low_bits > 57
        return (self.window[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _one(self, k: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.dir, k, side="right") - 1
        return w * 64 + _select_in_words(self.high[w], k - self.dir[w].astype(np.int64))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.zeros, k, side="right") - 1
        return w * 64 + _select_in_words(~self.high[w], k - self.zeros[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i (int64)."""
        i = i.astype(np.int64)
        return ((self._one(i) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)).astype(np.int64)

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least place in [first, last) whose value is at least x; last if there is none."""
        high = x.astype(np.int64) >> self.low_bits
        most = int(self.zeros[-1]) + 64 - bin(int(self.high[-1])).count("1")  # zeros in all
        past = high >= most
        h = np.where(past, 0, high)
        a = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)
        b = self._zero(h) - h
        a, b = np.where(past, self.n, a), np.where(past, self.n, b)
        a, b = np.clip(a, first, last), np.clip(b, first, last)
        low = x.astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        return a

    def find(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place in [first, last), whose values differ, of value x; -1 if it isn't there."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        x = x.astype(np.int64)
        h = x >> self.low_bits
        past = h >= int(self.zeros[-1]) + 64 - int(self.high[-1]).bit_count()
        h[past] = 0
        # values with these high bits lie between two zeros, of which the second mostly is in the first one's word
        zero = self._zero(np.maximum(h - 1, 0))
        rest = (~self.high[zero >> 6] >> (zero & 63).astype(_U)) >> _U(1)
        stop = zero + 1 + np.bitwise_count((rest & (~rest + _U(1))) - _U(1)) - h
        far = np.flatnonzero((rest == 0) | (h == 0))
        stop[far] = self._zero(h[far]) - h[far]
        a, stop = np.maximum(np.where(h > 0, zero - h + 1, 0), first), np.minimum(stop, last)
        stop[past] = 0
        low, b = x.astype(np.uint64) & np.uint64((1 << self.low_bits) - 1), stop.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        at = np.flatnonzero(a < stop)
        at = at[self._low(a[at]) == low[at]]
        out = np.full(len(x), -1, np.int64)
        out[at] = a[at]
        return out

"""A wavelet matrix over whole numbers: one bit-plane a level, with rank and select.

The planes hold as many bits as the values themselves would. Level by level, from the
highest bit down, the sequence is split by that bit, zeros first and each part in
order; a plane is the row of these bits. Ranks of each ``SPAN`` bits stand beside a
plane, so that any rank takes one table look-up and the bits of one span.
"""

from __future__ import annotations

import numpy as np

#: Bits that share an entry of the rank table.
SPAN = 512
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


class WaveletMatrix:
    """``n`` values of ``len(planes)`` bits; ``planes`` are bytes, ``zeros`` the number of zero bits of each."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]) -> None:
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @staticmethod
    def build(values: np.ndarray, width: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        left = values
        for level in range(width - 1, -1, -1):
            bits = left & left.dtype.type(1 << level) != 0
            plane = np.packbits(bits)
            planes.append(plane.tobytes())
            zeros.append(int(len(bits) - np.count_nonzero(bits)))
            per_span = np.add.reduceat(_BITS[plane], np.arange(0, len(plane), SPAN // 8), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(per_span)]).astype(np.uint32).tobytes())
            left = np.concatenate([np.compress(~bits, left), np.compress(bits, left)])
        return WaveletMatrix(len(values), planes, zeros, ranks)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Number of one bits before each position of a level."""
        plane, span = self.planes[level], at // SPAN
        found = self.ranks[level][span].astype(np.int64)
        for k in range(SPAN // 8):
            byte = span * (SPAN // 8) + k
            inside = np.flatnonzero(byte * 8 < at)
            if not len(inside):
                break
            have = np.minimum(at[inside] - byte[inside] * 8, 8)
            found[inside] += _BITS[plane[byte[inside]] & (0xFF00 >> have & 0xFF).astype(np.uint8)]
        return found

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at some positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at), self._ones(level, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def all(self) -> np.ndarray:
        """Every value, in order: the sequence is put together again from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            merged = np.empty(self.n, kind)
            merged[np.flatnonzero(~bits)] = out[: self.zeros[level]]
            merged[np.flatnonzero(bits)] = out[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            out = merged
        return out.astype(np.uint32)

    def _range(self, value: int, end: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``value`` begins below the last level, and its end for the first ``end`` positions."""
        begin, end = np.zeros(1, np.int64), np.atleast_1d(np.asarray(end, np.int64))
        for level in range(len(self.planes)):
            low, high = self._ones(level, begin), self._ones(level, end)
            one = value >> (len(self.planes) - 1 - level) & 1
            begin, end = (self.zeros[level] + low, self.zeros[level] + high) if one else (begin - low, end - high)
        return begin, end

    def rank(self, value: int, end: np.ndarray) -> np.ndarray:
        """How often ``value`` is found before each of some positions."""
        if value >> len(self.planes):
            return np.zeros(len(np.atleast_1d(end)), np.int64)
        begin, end = self._range(value, end)
        return end - begin

    def select(self, value: int) -> np.ndarray:
        """All positions of ``value``, in order: its run below the last level, followed back up."""
        if value >> len(self.planes):
            return np.zeros(0, np.int64)
        begin, end = self._range(value, self.n)
        at = np.arange(int(begin[0]), int(end[0]))
        for level in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - level) & 1
            at = self._place(level, one, at - (self.zeros[level] if one else 0))
        return at

    def _place(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Position of each nth (from 0) one or zero bit of a level: its span by the rank table, then the bits of the spans that are asked for."""
        if not len(nth):
            return nth
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * SPAN, self.n) - ones
        span = np.searchsorted(before, nth, side="right") - 1
        asked, inverse = np.unique(span, return_inverse=True)
        bytes_ = asked[:, None] * (SPAN // 8) + np.arange(SPAN // 8)
        bits = np.unpackbits(np.where(bytes_ < len(self.planes[level]), self.planes[level][np.minimum(bytes_, len(self.planes[level]) - 1)], 0).astype(np.uint8), axis=1) == bit
        bits &= asked[:, None] * SPAN + np.arange(SPAN) < self.n
        flat = np.flatnonzero(bits)
        first = np.concatenate([[0], np.cumsum(bits.sum(axis=1))])
        return asked[inverse] * SPAN + flat[first[inverse] + nth - before[span]] % SPAN

"""Vectorised word splitting and hashing over UTF-8 bytes.

Texts are handled as byte strings in chunks of about a megabyte. A 64-bit
polynomial over prefix sums gives the hash of every word without a Python loop;
windows of words combine the mixed word hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_WHITE = (9, 10, 11, 12, 13, 32)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 20
#: Words of more bytes get another hash: such a polynomial has collisions among long words of a certain build.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(lower: bool = False, seed: int = 1, separators: Iterable[int] = _WHITE) -> np.ndarray:
    """A random value for each byte, 0 for those that separate words."""
    table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest chunk so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + (CHUNK >> 3))
            ones = np.ones(size, np.uint64)
            ones[1:] = np.uint64(_BASE)
            self.up = np.cumprod(ones)
            ones[1:] = np.uint64(pow(_BASE, -1, 2**64))
            self.down = np.cumprod(ones)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def words(texts: list[bytes], *tables: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, bytes]:
    """Words of a chunk of texts, in order.

    Returns the index of each text's first word (one more entry than texts), the
    words' hashes by each table (then, by the last one, those of their first bytes,
    as many as each of ``heads`` says), their first and end byte, and the bytes.
    """
    buffer = b"\n".join(texts)
    raw = np.frombuffer(buffer, np.uint8)
    n = len(raw)
    up, down = _powers.upto(n + 1)
    outside = np.ones(n + 2, np.int8)
    outside[1:-1] = tables[0][raw] == 0
    edge = np.diff(outside)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = []
    for table in tables:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[raw] * up[:n], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        for at in np.flatnonzero(ends - starts > LONG):
            word = buffer[starts[at] : ends[at]]
            hashes[-1][at] = xxhash.xxh3_64_intdigest(word.lower() if table[65] == table[97] else word, int(table[48]))
    for k in heads:
        cut = np.minimum(ends, starts + k)
        hashes.append(mix((sums[cut] - sums[starts]) * down[starts] ^ np.uint64(k << 56)))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return np.searchsorted(starts, offsets), hashes, starts, ends, buffer


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; runs that cross a text's end are for the caller to leave out."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= _STEP
        out += h[k : k + n]
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each window that lies within one text, and that text's index."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(total) - before[text] + first[:-1][text], text


def as_bytes(column) -> list[bytes]:
    """An Arrow string column (plain, large or chunked) as byte strings; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]

"""Removal of word windows that already start in an earlier document.

A Count-min prefilter and an exact second pass, both sharded by hash range so
that neither a sketch nor a window list ever has to fit in one place:

1. Documents are dealt over blocks of about equal size, by hash. Each block is one
   partition of the sketch: the non-zero counters of its windows, as sorted lists
   in ``depth`` rows, split by counter range. (A counter says in how many blocks it
   was hit; it saturates at two.)
2. Each counter range is merged over all blocks. Every block gets back one bit
   for each counter it sent: whether another block hit it too. Counters that two
   windows share only raise the estimate, so no repeated window is lost.
3. Windows whose estimate (the least of their counters) is two or more are
   grouped exactly, by 128-bit digest, with the least doc_id of each block. Every
   block gets back the least of all where that is less than its own.
4. Windows repeated inside one block are found there, by the same digest.

The texts are shuffled once, by block; all passes read that exchange. A partition
takes many blocks, or many ranges, one after the other: how many partitions there are
follows the bytes, so a task's share does not grow with the input, nor does the number
of shuffle blocks with the number of messages. There are ``2 ** RANGES`` ranges a row, so
each block sends a bounded number of messages, up to ``WIDEST`` counters a range (an
input of some terabytes); beyond that raise ``block_bytes`` with the executors' memory.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, outer_id
from .tokens import as_bytes, byte_table, chunks, mix, window_starts, windows, words

SEGMENT = "block long, kind int, shard long, payload binary"
_SEGMENT = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("payload", pa.binary())])
_EXACT = 100
#: Bytes of text a partition; ranges of a sketch row, and the bits of the widest one.
PART_BYTES, RANGES, WIDEST = 64 << 20, 12, 26


def encode(values: np.ndarray) -> bytes:
    """Increasing non-negative numbers as differences of one, two or four bytes (a prefix code by the low bits)."""
    d = np.diff(values, prepend=0).astype(np.uint64)
    size = np.where(d < 1 << 7, 1, np.where(d < 1 << 14, 2, 4))
    coded = np.where(size == 1, d << np.uint64(1), np.where(size == 2, (d << np.uint64(2)) | np.uint64(1), (d << np.uint64(2)) | np.uint64(3))).astype(np.uint32)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        out[at[has] + k] = (coded[has] >> np.uint32(8 * k)).astype(np.uint8)
    return len(values).to_bytes(4, "little") + np.packbits(size == 4).tobytes() + np.packbits(size == 1).tobytes() + out.tobytes()


def decode(payload: bytes) -> np.ndarray:
    n = int.from_bytes(payload[:4], "little")
    flags = (n + 7) // 8
    four = np.unpackbits(np.frombuffer(payload, np.uint8, flags, 4), count=n).astype(bool)
    one = np.unpackbits(np.frombuffer(payload, np.uint8, flags, 4 + flags), count=n).astype(bool)
    raw = np.frombuffer(payload, np.uint8, offset=4 + 2 * flags)
    size = np.where(four, 4, np.where(one, 1, 2))
    at = np.cumsum(size) - size
    coded = np.zeros(n, np.int64)
    for k in range(4):
        has = size > k
        coded[has] |= raw[at[has] + k].astype(np.int64) << (8 * k)
    return np.cumsum(np.where(one, coded >> 1, coded >> 2))


class _Block:
    """Windows of one block's documents, which are in the order of their ids."""

    def __init__(self, table: pa.Table, size: int) -> None:
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.ids = table.column("doc_id").to_numpy()
        self.texts = as_bytes(table.column("text"))
        self.size = size
        tables = [byte_table(seed=1), byte_table(seed=2)]
        found: list[list[np.ndarray]] = [[] for _ in tables]
        first, where, text = [], [], []
        base = 0
        for begin, end in chunks(self.texts):
            offsets, hashes, *_ = words(self.texts[begin:end], *tables)
            starts, owner = window_starts(offsets, size)
            for kept, h in zip(found, hashes, strict=True):
                kept.append(windows(h, size)[starts])
            first.append(offsets[:-1] + base)
            where.append(starts + base)
            text.append(owner + begin)
            base += int(offsets[-1])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.first = np.append(join(first, np.int64), base)
        self.where, self.text = join(where, np.int64).astype(np.int32), join(text, np.int64).astype(np.int32)
        del where, text
        one, two = (join(parts, np.uint64) for parts in found)
        found.clear()
        #: The distinct windows, in the order of their first halves, the place of the first of each, and which each place has.
        self.unique, self.at, self.inverse = np.unique(one, return_index=True, return_inverse=True)
        self.inverse = self.inverse.astype(np.int32)
        if (two[self.at][self.inverse] != two).any():
            order = np.lexsort((two, one))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
            self.inverse = np.zeros(len(order), np.int32)
            self.inverse[order] = np.cumsum(new) - 1
            self.at = order[new]
            self.unique = one[self.at]
        self.second = two[self.at]
        #: The least id in this block that has each window.
        self.least = self.ids[self.text[self.at]] if len(self.at) else np.zeros(0, np.int64)

    def counters(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct counters of a sketch row that this block hits, and which of them each window has."""
        seed = np.uint64(0xA0761D6478BD642F * (row + 1) % 2**64)
        return np.unique(mix(self.unique ^ seed) >> np.uint64(64 - bits), return_inverse=True)

    def estimated(self, sent: dict[int, list[tuple[int, bytes]]], depth: int, bits: int) -> np.ndarray:
        """Whether each distinct window's estimate is two blocks or more."""
        out = np.ones(len(self.unique), bool)
        for row in range(depth):
            counters, inverse = self.counters(row, bits)
            out &= joined(sent.get(row, []), len(counters))[inverse]
        return out


def joined(parts: list[tuple[int, bytes]], n: int) -> np.ndarray:
    """Bits that came back shard by shard, as one array of ``n``."""
    pieces = [np.unpackbits(np.frombuffer(p, np.uint8, offset=4), count=int.from_bytes(p[:4], "little")) for _, p in sorted(parts)]
    out = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    if len(out) != n:
        raise ValueError(f"{len(out)} bits came back for {n} values")
    return out.astype(bool)


def bits_of(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def segments(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _SEGMENT.types, strict=True)], schema=_SEGMENT)


def received(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list[tuple[int, bytes]]] = {}
    for kind, shard, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "payload")), strict=True):
        out.setdefault(kind, []).append((shard, payload))
    return out


def answered(parts: list[tuple[int, bytes]], own: np.ndarray) -> np.ndarray:
    """The least ids that came back shard by shard: where a bit is set the one sent with it, otherwise the block's own."""
    out, at = own.copy(), 0
    for _, p in sorted(parts):
        n = int.from_bytes(p[:4], "little")
        set_ = np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8, (n + 7) // 8, 4), count=n))
        out[at + set_] = np.frombuffer(p, np.int64, len(set_), 4 + (n + 7) // 8)
        at += n
    if at != len(own):
        raise ValueError(f"{at} answers came back for {len(own)} windows")
    return out


def substring_dedup(docs: DataFrame, window: int = 13, depth: int = 2, spread: float = 2.0, block_bytes: int = 6 << 20, shard_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_words, n_removed and text (kept words, joined by one space), a row per document.

    A word is a run of characters other than ASCII white space. It goes when a
    window of ``window`` words that covers it also starts in a document with a
    smaller id; windows are judged on the input. ``spread`` is the least number
    of counters of each sketch row for each word of the corpus.

    Null or empty text: no words. Null doc_id: later than every other id; such
    rows do not remove words from one another. Rows that repeat a doc_id: none is
    smaller, so they keep what they share. Fewer words than a window: all kept.
    An empty table gives an empty table; columns other than the two named are
    not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(total["b"] or 0) // block_bytes))
    counters = spread * max(1, (total["b"] or 0) / 6)
    bits = min(60, max(shard_bits or 22, int(np.ceil(np.log2(counters)))))
    shard_bits = shard_bits or min(WIDEST, max(22, bits - RANGES))
    exact_bits = min(40, max(0, int(np.ceil(np.log2(max(1, counters / spread / (1 << 20)))))))
    # The text too is in the hash: rows of one id, or of none, do not meet in one block.
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    parts = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-(total["b"] or 0) // PART_BYTES))
    by_block = dealt.repartition(min(blocks, parts), "block").groupBy("block")

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        block, rows = _Block(table, window), []
        for row in range(depth):
            values, _ = block.counters(row, bits)
            shards = (values >> np.uint64(shard_bits)).astype(np.int64)
            low = (values & np.uint64((1 << shard_bits) - 1)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for part, at in zip(np.split(low, cuts), np.r_[0, cuts], strict=True):
                if len(part):
                    rows.append((key[0].as_py(), row, int(shards[at]), encode(part)))
        return segments(rows)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        hits = np.zeros(1 << shard_bits, np.uint8)
        lists = [decode(p) for p in table.column("payload").to_pylist()]
        for x in lists:
            hits[x] = np.minimum(hits[x] + 1, 2)
        kind, shard = key[0].as_py(), key[1].as_py()
        return segments([(b, kind, shard, bits_of(hits[x] > 1)) for b, x in zip(table.column("block").to_pylist(), lists, strict=True)])

    def candidates(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, rows = _Block(left, window), []
        repeated = block.estimated(received(right), depth, bits)
        one, two, least = block.unique[repeated], block.second[repeated], block.least[repeated]
        shards = (one >> np.uint64(64 - exact_bits) if exact_bits else np.zeros(len(one), np.uint64)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for a, b, c, at in zip(np.split(one, cuts), np.split(two, cuts), np.split(least, cuts), np.r_[0, cuts], strict=True):
            if len(a):
                rows.append((key[0].as_py(), _EXACT, int(shards[at]), a.tobytes() + b.tobytes() + c.tobytes()))
        return segments(rows)

    def group(key: tuple, table: pa.Table) -> pa.Table:
        blocks_, payloads = table.column("block").to_pylist(), table.column("payload").to_pylist()
        parts = [np.frombuffer(p, np.uint64).reshape(3, -1) for p in payloads]
        one, two, ids = np.concatenate(parts, axis=1)
        ids = ids.view(np.int64)
        order = np.lexsort((ids, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
        least = np.zeros(len(order), np.int64)
        least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        cuts = np.cumsum([p.shape[1] for p in parts])[:-1]
        return segments([(b, _EXACT, key[0].as_py(), bits_of(x < own) + x[x < own].tobytes()) for b, x, own in zip(blocks_, np.split(least, cuts), np.split(ids, cuts), strict=True)])

    def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, sent = _Block(left, window), received(right)
        repeated = block.estimated(sent, depth, bits)
        least = block.least.copy()
        least[repeated] = answered(sent.get(_EXACT, []), least[repeated])
        hit = block.ids[block.text] > least[block.inverse]
        change = np.zeros(int(block.first[-1]) + window + 1, np.int32)
        np.add.at(change, block.where[hit], 1)
        np.add.at(change, block.where[hit] + window, -1)
        keep = np.cumsum(change)[: int(block.first[-1])] == 0
        kept, n, gone = [], np.diff(block.first), []
        for text, a, b in zip(block.texts, block.first[:-1], block.first[1:], strict=True):
            mask = keep[a:b]
            left_over = int(np.count_nonzero(mask))
            gone.append(b - a - left_over)
            kept.append(b" ".join(text.split() if left_over == b - a else compress(text.split(), mask.tolist())))
        return pa.table({"doc_id": pa.array(block.ids), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "text": pa.array(kept, pa.binary()).cast(pa.string())})

    shards = depth << (bits - shard_bits)
    seen = by_block.applyInArrow(sketch, SEGMENT).repartition(min(shards, parts), "kind", "shard").groupBy("kind", "shard").applyInArrow(merge, SEGMENT)
    wanted = by_block.cogroup(seen.groupBy("block")).applyInArrow(candidates, SEGMENT)
    earlier = wanted.repartition(min(1 << exact_bits, parts), "shard").groupBy("shard").applyInArrow(group, SEGMENT)
    out = by_block.cogroup(seen.unionByName(earlier).groupBy("block")).applyInArrow(apply, "doc_id long, n_words long, n_removed long, text string")
    return out.select(outer_id(), "n_words", "n_removed", "text")

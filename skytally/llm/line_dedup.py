"""Removal of lines that are similar to an earlier line: an exact set-similarity join.

A line's tokens are its distinct words. Lines with equal sets are one class,
known by its first line; the join is between these.

1. One pass counts tokens in a hashed table of fixed size. The counts give all
   lines the same order of tokens, rare ones first (any common order keeps the
   filters exact). A second pass packs lines by class; each class says which of its
   lines is the first and sends that one's prefix to the places of its tokens.
2. Sets of similarity ``t`` or more share a token among the first
   ``n - ceil(t * n) + 1`` of the longer and the first
   ``n - ceil(2 * t / (1 + t) * n) + 1`` of the shorter: these prefixes meet by
   token, under the length filter, the positional filter (what can still match
   behind the two positions must suffice) and a parity filter: each token flips
   one of 64 bits of its line, and sets differ in at least as many tokens as these
   differ in bits.
3. What matters is whether *some* earlier line matches. So for each line only the
   ``nearest`` candidates of each token, by parity, are looked at first, which
   settles groups of near copies without their pairs. Where none of these matches
   and there are more, a second round takes all earlier lines of the token.
4. Every candidate is verified on the full sets, read from the texts; a table of
   fixed size says which lines may be wanted, and a join what is.

A token with more than ``HOT`` words is dealt over cells. In the first round a
line meets its own cell only; lines that match nothing there go to every cell in
the second. Only texts that lose lines, and those that share their slot, are
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, materialise, outer_id
from .tokens import as_bytes, byte_table, chunks, mix, words

#: Bits of the table of counts, its slices, and slots of the table of wanted lines, documents or tokens.
BUCKET_BITS, SLICES, SLOTS = 20, 64, 1 << 25
#: Words of a token's slot from which its lines are dealt over cells, and lines that are packed at once.
HOT, FLUSH = 1 << 20, 1 << 18
#: Buckets that a task takes, one after the other.
TASK_BUCKETS = 2
#: Candidates that are compared at once.
AT_ONCE = 1 << 18
_TABLE = byte_table(lower=True, seed=11)
_LINE = np.dtype([("key", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("parity", "<u8"), ("line", "<u4"), ("n", "<u4"), ("tokens", "<u4")])
_ENTRY = np.dtype([("token", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("parity", "<u8"), ("line", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("role", "u1")])
_PLACE = np.dtype([("doc", "<i8"), ("text", "<i8"), ("line", "<u4")])
_TWINS = np.dtype([("a", _PLACE), ("b", _PLACE)])
#: What a packed row holds, and what a found row says: a pair to verify, a line that an equal one precedes, a line with more candidates, lines of one class and place.
_PAIR, _GONE, _MORE, _TWIN = range(4)
#: An entry may be the earlier line of a pair, the later one, or both.
_EARLIER, _LATER = 1, 2
_LINES = "bucket long, lines binary, tokens binary"
_PACKED = "bucket long, kind int, payload binary"
_SIDES = [f"{side}_{field}" for side in "ab" for field in ("doc", "text", "line")]
_FOUND = "kind int, " + ", ".join(f"{c} long" for c in _SIDES) + ", token long"


class _Lines:
    """The lines of a chunk of texts: each distinct token of each line once, by line."""

    def __init__(self, texts: list[bytes]) -> None:
        first, (h,), starts, _, buffer = words(texts, _TABLE)
        newlines = np.concatenate([[0], np.flatnonzero(np.frombuffer(buffer, np.uint8) == 10) + 1])
        line_of_word = np.searchsorted(newlines, starts, "right") - 1
        text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        first_line = np.searchsorted(newlines, text_start)
        self.text_of_line = np.searchsorted(first_line, np.arange(len(newlines)), "right") - 1
        self.number = np.arange(len(newlines)) - first_line[self.text_of_line]
        order = np.argsort(line_of_word.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)) if len(newlines) < 1 << 24 else np.lexsort((h, line_of_word))
        line, token = line_of_word[order], h[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(line) != 0) | (np.diff(token) != 0)
        self.line, self.token = line[new], token[new]
        #: Lines that have tokens, and where each one's tokens begin.
        self.filled, self.begin = np.unique(self.line, return_index=True)
        self.n = np.diff(np.append(self.begin, len(self.line)))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.begin):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        a = np.add.reduceat(mix(self.token), self.begin)
        b = np.add.reduceat(mix(self.token ^ np.uint64(0x5851F42D4C957F2D)), self.begin)
        return mix(a + self.n.astype(np.uint64)), mix(b)

    def parity(self) -> np.ndarray:
        return np.bitwise_xor.reduceat(np.uint64(1) << (self.token & np.uint64(63)), self.begin) if len(self.begin) else np.zeros(0, np.uint64)


def _bucket(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's token counts, in slices, and its bytes of text."""
    total, size = np.zeros(1 << BUCKET_BITS, np.int64), 0
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for begin, end in chunks(texts):
            total += np.bincount(_bucket(words(texts[begin:end], _TABLE)[1][0]), minlength=len(total))
        size += sum(map(len, texts))
    parts = np.split(np.minimum(total, 2**32 - 1).astype("<u4"), SLICES)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(np.full(SLICES, size))], ["part", "counts", "size"])


def _merge_counts(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p, "<u4").astype(np.int64) for p in table.column("counts").to_pylist())
    return pa.table({"part": [key[0].as_py()], "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary()), "size": [pc.sum(table.column("size")).as_py()]})


def _slot(doc, text, line, mod=lambda x: x % SLOTS):
    """Slot of a line (numbers), the same by numpy and by columns."""
    return mod(mod(doc) * 20_392_817 + mod(text) * 6_700_417 + mod(line) * 9_737_333)


def _marked(places: DataFrame) -> np.ndarray:
    """Which slots the lines (doc, text, line) have: a table of fixed size, as 64-bit words."""
    at = _slot(F.col("doc"), F.col("text"), F.col("line"), lambda x: F.pmod(x, F.lit(SLOTS)))
    bits = places.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(SLOTS >> 6, np.int64)
    table[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return table


def _in(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def _digests(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def _tokens(line: bytes) -> set[bytes]:
    return set(line.lower().split())


def _segments(bucket: np.ndarray, *parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """The distinct buckets of sorted rows, and for each part (bytes, where each row's begin) the bytes of each bucket."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    out = []
    for raw, begin in parts:
        offsets = np.append(begin[cuts], raw.nbytes).astype(np.int64)
        out.append(pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]).cast(pa.binary()))
    return bucket[cuts], out


def _records(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return records, np.arange(len(records), dtype=np.int64) * records.dtype.itemsize


def _joined(column: pa.Array | pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _places(records: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), _PLACE)
    for field in _PLACE.names:
        out[field] = records[field]
    return out


def _by_class(lines: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines sorted by class, then place; which are the first of their class; the tokens of these alone, in this order."""
    begin = np.cumsum(lines["tokens"]) - lines["tokens"]
    order = np.lexsort((lines["text"], lines["line"], lines["doc"], lines["check"], lines["key"]))
    lines, begin = lines[order], begin[order]
    first = np.ones(len(lines), bool)
    first[1:] = (lines["key"][1:] != lines["key"][:-1]) | (lines["check"][1:] != lines["check"][:-1])
    counts = np.where(first, lines["tokens"], 0).astype(np.int64)
    lines["tokens"] = counts
    return lines, first, tokens[np.repeat(begin.astype(np.int64) - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]


def _narrow(tokens: np.ndarray) -> np.ndarray:
    """Tokens of 40 bits as five bytes each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class _Join:
    """The steps of one round: the first, or the second if the lines and tokens are given that the first left open."""

    def __init__(self, t: float, counts, buckets: int, nearest: int, hot: int, open_lines=None, open_tokens=None) -> None:
        self.t, self.counts, self.buckets, self.nearest, self.hot, self.open_lines, self.open_tokens = t, counts, buckets, nearest, hot, open_lines, open_tokens
        self.least = t / (1 - t)

    def lines(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines that have tokens, packed by class, with the tokens of the prefixes.

        A token's key is its count on a scale of logarithms, then 30 bits of its
        hash; tokens of one key count as one here, which adds candidates only.
        Tokens that occur once come first and are left out; where only equal sets
        match there is no prefix.
        """
        scale = (np.log2(np.maximum(self.counts.value, 1)) * 31).astype(np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(), as_bytes(batch.column("text"))
            for begin, end in chunks(texts):
                held.append(self._packed(_Lines(texts[begin:end]), ids[begin:end], _digests(texts[begin:end]), scale))
                if sum(len(x) for x, _ in held) >= FLUSH:
                    yield self._flush(held)
                    held = []
        if held:
            yield self._flush(held)

    def _packed(self, lines: _Lines, ids: np.ndarray, digests: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.repeat(np.arange(len(lines.filled)), lines.n)
        key = scale[_bucket(lines.token)] << np.uint64(30) | lines.token >> np.uint64(14) & np.uint64((1 << 30) - 1)
        if len(lines.filled) < 1 << 24:
            key = np.sort(rank.astype(np.uint64) << np.uint64(40) | key) & np.uint64((1 << 40) - 1)
        else:
            key = key[np.lexsort((key, rank))]
        position, length = np.arange(len(key)) - np.repeat(lines.begin, lines.n), lines.n[rank]
        at = np.flatnonzero((length + 1e-9 >= self.least) & (position <= length - np.ceil(self.t * length - 1e-9)) & (key >> np.uint64(30) > 0))
        out = np.zeros(len(lines.filled), _LINE)
        text = lines.text_of_line[lines.filled]
        out["key"], out["check"] = lines.keys()
        out["doc"], out["text"], out["line"], out["n"], out["parity"] = ids[text], digests[text], lines.number[lines.filled], lines.n, lines.parity()
        out["tokens"] = np.bincount(rank[at], minlength=len(out))
        return out, key[at]

    def reopened(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of packed lines those with a token that is open; a class's first line has its tokens still."""
        for batch in batches:
            lines, tokens = _joined(batch.column("lines"), _LINE), _wide(b"".join(batch.column("tokens").to_pylist()))
            owner = np.repeat(np.arange(len(lines)), lines["tokens"])
            wanted = np.zeros(len(lines), bool)
            wanted[owner[_in(self.open_tokens.value, _slot(tokens.astype(np.int64), 0, 0))]] = True
            if wanted.any():
                yield self._flush([(lines[wanted], tokens[wanted[owner]])])

    def _flush(self, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        lines, _, tokens = _by_class(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        bucket = ((lines["key"] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        begin = (np.cumsum(lines["tokens"], dtype=np.int64) - lines["tokens"]) * 5
        found, (packed, narrow) = _segments(bucket, _records(lines), (_narrow(tokens), begin))
        return pa.RecordBatch.from_arrays([pa.array(found), packed, narrow], ["bucket", "lines", "tokens"])

    def classes(self, key: tuple, table: pa.Table) -> pa.Table:
        """Each class of a bucket: the prefix of its first line, by token; its later lines, and others at the first one's place."""
        lines, first, tokens = _by_class(_joined(table.column("lines"), _LINE), _wide(b"".join(table.column("tokens").to_pylist())))
        head = lines[np.flatnonzero(first)[np.cumsum(first) - 1]]
        same_place = (lines["doc"] == head["doc"]) & (lines["line"] == head["line"])
        twins = same_place & (lines["text"] != head["text"])
        twin = np.zeros(int(twins.sum()), _TWINS)
        twin["a"], twin["b"] = _places(head[twins]), _places(lines[twins])
        own = key[0].as_py()
        rows = [(own, _GONE, _places(lines[~same_place]).tobytes()), (own, _TWIN, twin.tobytes())]
        bucket, entries = self._entries(lines[first], tokens)
        found, (packed,) = _segments(bucket, _records(entries))
        rows = [r for r in rows if r[2]]
        return pa.table({
            "bucket": pa.concat_arrays([pa.array(found, pa.int64()), pa.array([r[0] for r in rows], pa.int64())]),
            "kind": pa.array([_PAIR] * len(found) + [r[1] for r in rows], pa.int32()),
            "payload": pa.concat_arrays([packed, pa.array([r[2] for r in rows], pa.binary())]),
        })

    def _cells(self, token: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.ceil(np.exp2((token >> np.uint64(30)) / 31) / self.hot)).astype(np.int64)

    def _entries(self, heads: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An entry for each token of a prefix, sorted by the buckets they go to."""
        counts = heads["tokens"].astype(np.int64)
        owner = np.repeat(np.arange(len(heads)), counts)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
        out = np.zeros(len(tokens), _ENTRY)
        out["token"], out["role"] = tokens, _EARLIER | _LATER
        for field in ("doc", "text", "parity", "line", "n"):
            out[field] = heads[field][owner]
        # What is left out of a prefix stands before the rest.
        out["pos"] = out["n"] - np.ceil(self.t * out["n"] - 1e-9) + 1 - counts[owner] + place
        cells = self._cells(out["token"])
        cell = (mix(out["doc"].astype(np.uint64) ^ mix(out["text"].astype(np.uint64) + out["line"])) % cells.astype(np.uint64)).astype(np.int64)
        if self.open_tokens is not None:
            is_open = _in(self.open_lines.value, _slot(out["doc"], out["text"], out["line"].astype(np.int64)))
            out["role"] = np.where(is_open, _EARLIER | _LATER, _EARLIER)
            wanted = _in(self.open_tokens.value, _slot(tokens.astype(np.int64), 0, 0))
            out, cells, cell, is_open = (x[wanted] for x in (out, cells, cell, is_open))
            # An open line of a token with several cells visits the others too.
            many = np.flatnonzero(is_open & (cells > 1))
            visit = np.repeat(many, cells[many] - 1)
            step = np.arange(len(visit)) - np.repeat(np.cumsum(cells[many] - 1) - (cells[many] - 1), cells[many] - 1) + 1
            visitors = out[visit]
            visitors["role"] = _LATER
            cell = np.concatenate([cell, (cell[visit] + step) % cells[visit]])
            out = np.concatenate([out, visitors])
        bucket = (mix(out["token"] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return bucket[order], out[order]

    def candidates(self, key: tuple, table: pa.Table) -> pa.Table:
        """Pairs of places, the first before the second, that pass the filters; what the classes said goes through."""
        kind = table.column("kind").to_numpy()
        part = lambda k, dtype: _joined(table.column("payload").filter(pa.array(kind == k)), dtype)
        entries, gone, twins = part(_PAIR, _ENTRY), part(_GONE, _PLACE), part(_TWIN, _TWINS)
        a, b, more = self._pairs(entries)
        groups = [(_PAIR, a, b, np.zeros(len(a), np.uint64)), (_GONE, gone, gone, np.zeros(len(gone), np.uint64)), (_MORE, more, more, more["token"]), (_TWIN, twins["a"], twins["b"], np.zeros(len(twins), np.uint64))]
        columns = [np.concatenate([np.full(len(x), k, np.int32) for k, x, *_ in groups])]
        columns += [np.concatenate([g[side][field].astype(np.int64) for g in groups]) for side in (1, 2) for field in _PLACE.names]
        columns.append(np.concatenate([g[3].astype(np.int64) for g in groups]))
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["kind", *_SIDES, "token"])

    def _pairs(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of pairs, earlier and later ones, and those of later lines that have more than these."""
        t, top = self.t, (1 << 24) - 1
        e = e[np.lexsort((e["n"], e["token"]))]
        n, pos, parity, role, doc, line = e["n"].astype(np.int64), e["pos"].astype(np.int64), e["parity"].copy(), e["role"].copy(), e["doc"].copy(), e["line"].astype(np.int64)
        both = e["token"] << np.uint64(24)
        # Each entry in the short prefix of its line with those after it, of the same length or longer, in the length filter.
        last = np.searchsorted(both | np.minimum(n, top).astype(np.uint64), both | np.minimum(np.floor(n / t + 1e-9), top).astype(np.uint64), "right")
        counts = np.where(pos <= n - np.ceil(2 * t / (1 + t) * n - 1e-9), last - np.arange(len(e)) - 1, 0)
        ends = np.cumsum(counts)
        found, held = [np.zeros((3, 0), np.int64)], 0
        more = self._cells(e["token"]) > 1 if self.open_tokens is None else np.zeros(len(e), bool)
        low = 0
        while low < len(e):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
            c = counts[low:high]
            i = np.repeat(np.arange(low, high), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            low = high
            total = n[i] + n[j]
            ok = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) + 1e-9 >= t / (1 + t) * total
            i, j, total = i[ok], j[ok], total[ok]
            apart = np.bitwise_count(parity[i] ^ parity[j]).astype(np.int64)
            ok = apart <= (1 - t) / (1 + t) * total + 1e-9
            i, j, apart = i[ok], j[ok], apart[ok]
            ahead = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & (line[i] < line[j]))
            a, b = np.where(ahead, i, j), np.where(ahead, j, i)
            ok = ((doc[i] != doc[j]) | (line[i] != line[j])) & (role[a] & _EARLIER > 0) & (role[b] & _LATER > 0)
            found.append(np.stack([b[ok], a[ok], apart[ok]]))
            held += int(ok.sum())
            if held > 2 * AT_ONCE:
                found = [self._chosen(np.concatenate(found, axis=1), e, more)]
                held = found[0].shape[1]
        b, a, _ = self._chosen(np.concatenate(found, axis=1), e, more)
        return e[a], e[b], e[more]

    def _chosen(self, found: np.ndarray, e: np.ndarray, more: np.ndarray) -> np.ndarray:
        """In the first round, the nearest for each later line's entry; ``more`` is set where others are left out."""
        if self.open_tokens is not None:
            return found
        b, a, apart = found
        # Of equally near ones a hash decides, the same in every token's list, so that no line is everybody's candidate.
        place = mix(e["doc"].astype(np.uint64) ^ e["text"].astype(np.uint64) + e["line"])
        tie = mix(place[a] ^ mix(place[b]))
        order = np.lexsort((tie, apart, b))
        b = b[order]
        new = np.ones(len(b), bool)
        new[1:] = np.diff(b) != 0
        place = np.arange(len(b)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(b) else np.zeros(0, np.int64)
        more[b[place >= self.nearest]] = True
        return found[:, order[place < self.nearest]]


def _verified(docs: DataFrame, pairs: DataFrame, t: float, name: str) -> DataFrame:
    """The later lines (doc, text, line) of those pairs that are similar, written."""
    spark = docs.sparkSession
    side = lambda s, line=None: pairs.select(F.col(f"{s}_doc").alias("doc"), *((F.col(f"{s}_text").alias("text"), F.col(f"{s}_line").alias("line")) if line is None else (F.lit(0).alias("text"), F.lit(0).alias("line"))))
    table = spark.sparkContext.broadcast(_marked(side("a").union(side("b"))))
    owners = spark.sparkContext.broadcast(_marked(side("a", 0).union(side("b", 0))))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            own = np.flatnonzero(_in(owners.value, _slot(ids, 0, 0)))
            ids, texts = ids[own], as_bytes(batch.column("text").take(pa.array(own)))
            for begin, end in chunks(texts):
                digests, parts = _digests(texts[begin:end]), [text.split(b"\n") for text in texts[begin:end]]
                counts = np.array([len(p) for p in parts])
                text = np.repeat(np.arange(len(parts)), counts)
                line = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                doc, digest = ids[begin:end][text], digests[text]
                at = np.flatnonzero(_in(table.value, _slot(doc, digest, line)))
                values = list(chain.from_iterable(parts))
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(digest[at]), pa.array(line[at]), pa.array([values[k] for k in at], pa.binary())], ["doc", "text", "line", "value"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(map(_tokens, batch.column("value_a").to_pylist()), map(_tokens, batch.column("value_b").to_pylist()), strict=True):
                common = len(x & y)
                keep.append(common + 1e-9 >= t * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(f"b_{c}").filter(pa.array(keep, pa.bool_())) for c in _PLACE.names], list(_PLACE.names))

    full = materialise(docs.mapInArrow(wanted, "doc long, text long, line long, value binary").distinct(), name + "-texts")
    both = pairs.select(*_SIDES).distinct()
    for s in "ab":
        both = both.join(full.toDF(f"{s}_doc", f"{s}_text", f"{s}_line", f"value_{s}"), [f"{s}_doc", f"{s}_text", f"{s}_line"])
    out = materialise(both.mapInArrow(similar, "doc long, text long, line long").distinct(), name)
    discard(full)
    return out


def _round(lines: DataFrame, join: _Join, name: str) -> DataFrame:
    # The number of partitions follows the input, so a task's share does not grow with it.
    tasks = -(-join.buckets // TASK_BUCKETS)
    packed = lines.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda key, table: join.classes(key, table), _PACKED)
    return materialise(packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda key, table: join.candidates(key, table), _FOUND), name)


def _later(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.col("b_doc").alias("doc"), F.col("b_text").alias("text"), F.col("b_line").alias("line"), *more)


def dedup_lines(docs: DataFrame, similarity: float = 0.85, block_bytes: int = 8 << 20, nearest: int = 4, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_lines, n_removed, text, a row per document.

    Lines end at a newline; a line's tokens are its runs of characters other than
    ASCII white space, lower-cased (A-Z), each counted once. A line goes if an
    earlier one (smaller doc_id, or the same and further up), itself kept or not,
    has a Jaccard similarity of ``similarity`` or more with it. Lines are judged on
    the input; those that stay are joined by newlines.

    Null or empty text: one line, without tokens; such lines always stay. A null
    id counts as larger than any other and comes back as null. Rows that repeat
    an id: lines of one number do not precede one another; each row is judged by its
    own text. A document may be left with an empty text. An empty table gives an
    empty table; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    t, size = float(similarity), 0
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for part, merged, size in docs.mapInArrow(_survey, "part long, counts binary, size long").groupBy("part").applyInArrow(_merge_counts, "part long, counts binary, size long").collect():
        width = len(counts) // SLICES
        counts[part * width : (part + 1) * width] = np.frombuffer(merged, "<u4")
    shared_counts = spark.sparkContext.broadcast(counts.astype("<u4"))
    blocks = max(1, -(-size // block_bytes))
    place = list(_PLACE.names)

    # Packed lines are kept for the second round, which would tokenise all texts again.
    first = _Join(t, shared_counts, blocks, nearest, hot)
    packed = materialise(docs.mapInArrow(first.lines, _LINES), "packed-lines")
    found = _round(packed, first, "line-candidates")
    settled = _verified(docs, found.where(F.col("kind") == _PAIR), t, "settled-lines")
    open_ = materialise(_later(found.where(F.col("kind") == _MORE), "token").join(settled, place, "left_anti"), "open-lines")
    if not open_.isEmpty():
        lines, tokens = (spark.sparkContext.broadcast(_marked(x)) for x in (open_, open_.select(F.col("token").alias("doc"), F.lit(0).alias("text"), F.lit(0).alias("line"))))
        second = _Join(t, shared_counts, blocks, nearest, hot, lines, tokens)
        rest = _round(packed.mapInArrow(second.reopened, _LINES), second, "line-rest")
        again = _verified(docs, rest.where(F.col("kind") == _PAIR), t, "settled-rest")
        discard(rest)
        settled = settled.union(again)
    discard(packed)
    twins = found.where(F.col("kind") == _TWIN).join(settled.toDF("a_doc", "a_text", "a_line"), ["a_doc", "a_text", "a_line"], "left_semi")
    gone = materialise(_later(found.where(F.col("kind") == _GONE)).union(settled).union(_later(twins)), "gone-lines")
    for spent in (found, open_):
        discard(spent)
    losing = spark.sparkContext.broadcast(_marked(gone.select("doc", F.lit(0).alias("text"), F.lit(0).alias("line"))))

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~_in(losing.value, _slot(batch.column("doc_id").to_numpy(), 0, 0))))
            n = pc.add(pc.count_substring(rest.column("text"), "\n"), 1).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([rest.column("doc_id"), n, pa.array(np.zeros(len(n), np.int64)), rest.column("text")], ["doc_id", "n_lines", "n_removed", "text"])

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(_in(losing.value, _slot(batch.column("doc_id").to_numpy(), 0, 0))))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(_digests(as_bytes(own.column("text")))), own.column("text")], ["doc_id", "digest", "text"])

    def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lost: dict[tuple[int, int], set[int]] = {}
        for doc, digest, line in zip(*(right.column(c).to_pylist() for c in place), strict=True):
            lost.setdefault((doc, digest), set()).add(line)
        n, removed, out = [], [], []
        ids = left.column("doc_id").to_pylist()
        for own, text in zip(zip(ids, left.column("digest").to_pylist(), strict=True), as_bytes(left.column("text")), strict=True):
            gone_here, parts = lost.get(own, ()), text.split(b"\n")
            n.append(len(parts))
            removed.append(len(gone_here))
            out.append(b"\n".join(compress(parts, (k not in gone_here for k in range(len(parts))))) if gone_here else text)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(out, pa.binary()).cast(pa.string())})

    columns = "doc_id long, n_lines long, n_removed long, text string"
    block = lambda *c: F.pmod(F.xxhash64(*c), F.lit(blocks))
    tasks = -(-blocks // TASK_BUCKETS)
    texts = docs.mapInArrow(changed, "doc_id long, digest long, text string").withColumn("block", block("doc_id", "digest")).repartition(tasks, "block")
    lost = gone.withColumn("block", block("doc", "text"))
    out = docs.mapInArrow(unchanged, columns).unionAll(texts.groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(apply, columns))
    return out.select(outer_id(), "n_lines", "n_removed", "text")

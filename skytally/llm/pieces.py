"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text's characters, spaces as the meta symbol, start as single symbols; an agenda
of adjacent pairs that the vocabulary knows is worked off by score, best first and
leftmost of equals. Each candidate merge is skipped with the dropout rate, as a
hash says that is keyed by the seed, the document's id, the chunk's place in it and
the candidate's number: every occurrence of a word is cut by itself, and the same
way whenever the document is encoded again.

Symbols outside the vocabulary become byte pieces, and so does a meta symbol that
the text itself holds; decoding gives back every text exactly.

No merge crosses from a non-space to a space, or a newline (which only bytes
encode), so chunks (spaces and the run of other characters after them) are encoded
by themselves. The agendas of all chunks of a batch that have about the same length
are worked off together, a candidate of each at a time; nothing is kept from one
batch to the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, outer_id
from .tokens import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of the texts that are encoded at once (a longer text is taken by itself).
AT_ONCE = 1 << 20
#: Widths of the tables of symbols; chunks with more symbols than the last have an agenda each.
WIDTHS = (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)
#: Odd factors of a chunk's place and of a candidate's number, and of the table of pairs.
_PLACE, _TURN, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)
_NOTHING = -(1 << 30)
_NEVER = np.float32(-np.inf)
_POINTS = 0x110000


class Codec:
    """Encoder and decoder over the vocabulary of a SentencePiece model file."""

    def __init__(self, model: str, dropout: float, seed: int) -> None:
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=model)
        size = source.get_piece_size()
        pieces = [source.id_to_piece(i) for i in range(size)]
        plain = {pieces[i]: i for i in range(size) if not (source.is_control(i) or source.is_unknown(i) or source.is_byte(i) or source.is_unused(i))}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece of this vocabulary crosses chunks")
        self.byte_id = np.array([source.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # Symbols are the pieces, and the characters that only longer pieces have.
        symbol = dict(plain)
        for c in sorted({c for p in plain for c in p} - plain.keys()):
            symbol[c] = size + len(symbol) - len(plain)
        #: What a symbol outside the vocabulary is by itself: its code point, for byte pieces.
        self.n_pieces, self.point_of = size, {i: 0x20 if s == SPACE else ord(s) for s, i in symbol.items() if i >= size}
        self.symbol_of = np.full(_POINTS, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1 and s != SPACE:
                self.symbol_of[ord(s)] = i
        self.symbol_of[0x20] = symbol.get(SPACE, -1)
        n = size + len(symbol) - len(plain)
        #: A symbol's score as the result of a merge; the last entry is that of no merge.
        self.score = np.full(n + 1, _NEVER, np.float32)
        self.pairs: dict[tuple[int, int], int] = {}
        for p, i in plain.items():
            self.score[i] = source.get_score(i)
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    self.pairs[symbol[p[:k]], symbol[p[k:]]] = i
        self.bits = max(4, (4 * len(self.pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for (a, b), i in self.pairs.items():
            at = int(self._at(np.array([a << 32 | b]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.values[at] = a << 32 | b, i
        self.limit = np.uint64(min(2**64 - 1, int(dropout * 2**64)))
        self.dropout, self.seed = dropout, seed
        written = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte_id.tolist()):
            written[i] = bytes([b])
        #: The bytes that each id decodes to, one after the other, and where they lie.
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.length = np.array([len(w) for w in written])
        self.begin = np.cumsum(self.length) - self.length

    def _at(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each two symbols merge to; -1 if to nothing."""
        out = np.full(len(a), -1, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[open_].astype(np.int64) << 32 | b[open_]
        at = self._at(key)
        while len(open_):
            there = self.keys[at]
            hit = there == key
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            open_, key, at = open_[on], key[on], (at[on] + 1) % len(self.keys)
        return out

    def skips(self, keyed: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Whether the candidate of this number is skipped, for each chunk."""
        return np.full(len(keyed), self.dropout >= 1) if not 0 < self.dropout < 1 else mix(keyed + turn.astype(np.uint64) * _TURN) < self.limit

    def _together(self, symbols: np.ndarray, keyed: np.ndarray) -> np.ndarray:
        """Work off the agendas of the rows of a table; merged symbols stand where their first part stood, _NOTHING elsewhere."""
        n, width = symbols.shape
        symbol = symbols.ravel()
        into = np.full((n, width), -1, np.int32)
        into[:, :-1] = self.merged(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, -1)
        score = self.score[into]
        into, agenda = into.ravel(), score.ravel()
        after, before = np.tile(np.arange(1, width + 1, dtype=np.int16), n), np.tile(np.arange(-1, width - 1, dtype=np.int16), n)
        turn, rows = np.zeros(n, np.int64), np.arange(n)
        while len(rows):
            place = score[rows].argmax(axis=1)
            at = rows * width + place
            live = agenda[at] > _NEVER
            rows, at, place = rows[live], at[live], place[live]
            skip = self.skips(keyed[rows], turn[rows])
            turn[rows] += 1
            agenda[at[skip]] = _NEVER
            go = ~skip
            at, base, place = at[go], (rows * width)[go], place[go]
            second, previous, both = base + after[at], before[at], into[at]
            following = after[second]
            symbol[at], symbol[second], agenda[second] = both, _NOTHING, _NEVER
            after[at] = following
            inner = following < width
            third = base + np.minimum(following, width - 1)
            before[third[inner]] = place[inner]
            into[at] = self.merged(both, np.where(inner, symbol[third], _NOTHING))
            agenda[at] = self.score[into[at]]
            left = previous >= 0
            to = (base + previous)[left]
            into[to] = self.merged(symbol[to], both[left])
            agenda[to] = self.score[into[to]]
        return symbols

    def _alone(self, symbols: list[int], keyed: np.uint64) -> list[int]:
        """The same for one chunk, with its agenda as a heap."""
        n, score = len(symbols), self.score.tolist()
        skip = self.skips(np.full(3 * n, keyed), np.arange(3 * n)).tolist()
        after, before, tried = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        agenda = [(-score[m], i, i + 1, m) for i in range(n - 1) if (m := self.pairs.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if symbols[i] == _NOTHING or after[i] != j or self.pairs.get((symbols[i], symbols[j])) != both:
                continue
            tried += 1
            if skip[tried - 1]:
                continue
            symbols[i], symbols[j] = both, _NOTHING
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := self.pairs.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(agenda, (-score[m], a, b, m))
        return [s for s in symbols if s != _NOTHING]

    def encode(self, texts: list[str], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        text_begin = np.cumsum(lengths) - lengths
        space, newline = points == 0x20, points == 0x0A
        starts = newline.copy()
        starts[1:] |= newline[:-1] | (space[1:] & ~space[:-1])
        starts[text_begin[lengths > 0]] = True
        begin = np.flatnonzero(starts)
        size = np.diff(np.append(begin, len(points)))
        text = np.searchsorted(text_begin, begin, "right") - 1 if len(begin) else begin
        # Of texts that begin at one place all but the last are empty.
        first = np.searchsorted(begin, text_begin)
        key = np.array([xxhash.xxh3_64_intdigest(int(d).to_bytes(8, "little", signed=True), self.seed) for d in documents], np.uint64)
        keyed = mix(key[text] + (np.arange(len(begin)) - first[text]).astype(np.uint64) * _PLACE)
        symbols = self.symbol_of[points]
        # A character without a symbol is its code point, below zero; so is a meta symbol of the text's own.
        strange = np.flatnonzero(symbols < 0)
        symbols[strange] = -1 - points[strange].astype(np.int32)
        low = 1
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(rows):
                at = begin[rows, None] + np.arange(width)
                inside = np.arange(width) < size[rows, None]
                table = np.where(inside, symbols[np.minimum(at, len(points) - 1)], _NOTHING)
                symbols[at[inside]] = self._together(table, keyed[rows])[inside]
        for row in np.flatnonzero(size > low):
            own = slice(int(begin[row]), int(begin[row] + size[row]))
            merged = self._alone(symbols[own].tolist(), keyed[row])
            symbols[own] = _NOTHING
            symbols[own.start : own.start + len(merged)] = merged
        return self._ids(symbols, np.repeat(np.arange(len(texts)), lengths), len(texts))

    def _ids(self, symbols: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols; those without a piece as the bytes of their character."""
        has = symbols != _NOTHING
        symbols, text = symbols[has], text[has]
        point = np.where(symbols < 0, -1 - symbols.astype(np.int64), 0)
        for i, p in self.point_of.items():
            point[symbols == i] = p
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.n_pieces))
        if not len(odd):
            return symbols, np.bincount(text, minlength=n)
        raw = [chr(p).encode() for p in point[odd].tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = [len(b) for b in raw]
        out = np.repeat(symbols, counts)
        end = np.cumsum(counts)[odd]
        at = np.repeat(end - counts[odd] - (np.cumsum(counts[odd]) - counts[odd]), counts[odd]) + np.arange(int(counts[odd].sum()))
        out[at] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(text, counts, n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts that ids, ``counts`` of them each, stand for."""
        length = self.length[ids]
        total = int(length.sum())
        raw = self.written[np.repeat(self.begin[ids] - (np.cumsum(length) - length), length) + np.arange(total)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


@lru_cache(maxsize=1)
def codec(model: str, dropout: float, seed: int) -> Codec:
    """One for each Python worker."""
    return Codec(model, dropout, seed)


def encode_pieces(docs: DataFrame, model: str = MODEL, dropout: float = 0.1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, ids, n_pieces, decoded, a row per document; ``decoded`` is made from ``ids`` alone.

    Null or empty text: no pieces, decoded as empty. A null id comes back as null
    (documents without one are cut as if they shared one). Repeated rows are encoded alike.
    An empty table gives an empty table; other columns are not read. ``model`` is
    a path that every executor has.
    """

    def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
        begin = total = 0
        for i, t in enumerate(texts):
            if total and total + len(t) > AT_ONCE:
                yield begin, i
                begin, total = i, 0
            total += len(t)
        if begin < len(texts):
            yield begin, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, dropout, seed)
        for batch in batches:
            documents, texts = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist()
            for begin, end in parts(texts):
                ids, counts = own.encode(texts[begin:end], documents[begin:end])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(documents[begin:end]), lists, pa.array(counts, pa.int64()), own.decode(ids, counts)], ["doc_id", "ids", "n_pieces", "decoded"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, decoded string")
    return out.select(outer_id(), "ids", "n_pieces", "decoded")

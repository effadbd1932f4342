"""Benchmark decontamination: word seeds that lose nothing, then Smith-Waterman alignment.

The benchmark is a stated set of queries against all documents. It is taken in
blocks of bounded size (one, unless it is large); for each block:

1. one pass counts how often the documents have each of its words;
2. an alignment that scores a share s of an item's own score matches at least
   ``k = ceil(s * m)`` of the item's m words, so it matches one of any
   ``m - k + 1``: the rarest ones (those that no document has first, as they cost
   nothing) are its seeds. What is common in the corpus seeds nothing while an
   item has enough else, and no alignment is lost, whatever was edited;
3. such an alignment spans ``3 * m - 2 * s * m`` words of the document at most.
   A second pass cuts texts into overlapping stretches that hold any such span,
   finds the seeds, leaves out stretches that have fewer than k of the item's
   words, and aligns the others with the item, word by word. The score is that of
   the best local alignment as a share of the item's own: edits cost, but do not
   hide a copy.

Which share is enough is one function of the length for all items, ``enough``: half
of the item's own score, but never less than ``size`` matching words (an item of no
more words as a whole), as a few common words in a row are no copy.

Items of like length are sought together, so that a long one widens nobody else's
stretches; what is held of an item is in proportion to its words. A block's items are
broadcast: they come from ``BLOCK_BYTES`` of text, or from one longer item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_and_text, outer_id
from .tokens import as_bytes, byte_table, chunks, words

MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
BLOCK_BYTES = 16 << 20
_SPREAD = 0x9E3779B1
_SPLIT = [b for b in range(128) if not chr(b).isalnum()]
_TABLE = byte_table(lower=True, seed=5, separators=_SPLIT)


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: its score, and the passage's first and end word in it."""
    n = len(passage)
    ramp = -GAP * np.arange(n + 1)
    score, begin = np.zeros(n + 1), np.arange(n + 1)
    best, span = 0.0, (0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        fresh = np.maximum(np.maximum(diagonal, above), 0)
        origin = np.where(fresh == diagonal, begin[:-1], begin[1:])
        origin = np.where(fresh > 0, origin, np.arange(1, n + 1))
        lifted = np.concatenate([[0.0], fresh]) + ramp
        # A gap in the item carries on from the best cell to the left.
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score = top - ramp
        begin = np.concatenate([[0], origin])[source]
        at = int(score.argmax())
        if score[at] > best:
            best, span = float(score[at]), (int(begin[at]), at)
    return best, *span


def best_scores(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """The score of the best local alignment of each passage with the item beside it, many at once."""
    out = np.zeros(len(items), np.float32)
    order = np.lexsort(([len(p) for p in passages], [len(i) for i in items]))
    cells = np.cumsum(np.array([len(passages[k]) + 64 for k in order], np.int64)) >> 17
    for part in np.split(order, np.flatnonzero(np.diff(cells)) + 1) if len(order) else []:
        # What pads a short one matches nothing, so it raises no score.
        width, height = max(len(passages[k]) for k in part), max(len(items[k]) for k in part)
        # A column a pair, so that each step works on whole rows; scores are whole numbers.
        kind = np.int16 if 2 * height + width < 30_000 else np.int32
        a, b = np.full((width, len(part)), -1, np.int32), np.full((height, len(part)), -2, np.int32)
        for column, k in enumerate(part):
            a[: len(passages[k]), column], b[: len(items[k]), column] = passages[k], items[k]
        ramp = (-GAP * np.arange(width)).astype(kind)[:, None]
        match, miss, gap = kind(MATCH), kind(MISMATCH), kind(GAP)
        score, best = np.zeros((width + 1, len(part)), kind), np.zeros((width, len(part)), kind)
        for q in range(height):
            fresh = score[:-1] + np.where(a == b[q], match, miss)
            np.maximum(fresh, score[1:] + gap, out=fresh)
            np.maximum(fresh, 0, out=fresh)
            np.maximum(best, fresh, out=best)
            fresh += ramp
            # The largest so far, by doubled steps.
            reach = 1
            while reach < width:
                fresh[reach:] = np.maximum(fresh[reach:], fresh[:-reach])
                reach *= 2
            np.subtract(fresh, ramp, out=score[1:])
        out[part] = best.max(axis=0)
    return out


def _numbers(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each word among the sorted known ones; their count for other words."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices begin, begin + 1, ... of each of some runs, one run after another."""
    return np.repeat(begin, length) + _spread(length)


def enough(m: np.ndarray, least: float, size: int) -> np.ndarray:
    """The share of its own score at which an alignment with an item of ``m`` words is a copy."""
    return np.maximum(least, np.minimum(1.0, size / m))


class _Items:
    """Items of like length: their words as numbers, what a copy needs at least, and the seeds.

    ``which`` are their places among all items of the block.
    """

    def __init__(self, which: np.ndarray, items: list[np.ndarray], known: np.ndarray, uses: np.ndarray, share: np.ndarray) -> None:
        self.which, self.known, self.words, self.share = which, known, [np.searchsorted(known, h) for h in items], share
        self.length = m = np.array([len(h) for h in items])
        #: Matches of an alignment that scores enough, and the words of a text that it spans.
        self.matches = np.maximum(1, np.ceil(share * m - 1e-9).astype(np.int64))
        self.span = np.maximum(1, np.floor(3 * m - 2 * share * m + 1e-9).astype(np.int64))
        self.step = max(64, int(self.span.max()))
        self.flat, self.at = np.concatenate(self.words), np.cumsum(m) - m
        seeds = [np.unique(w[np.lexsort((w, uses[w]))[: max(0, len(w) - k + 1)]]) for w, k in zip(self.words, self.matches, strict=True)]
        word = np.concatenate(seeds)
        order = np.argsort(word, kind="stable")
        self.item_of_seed = np.repeat(np.arange(len(items)), [len(w) for w in seeds])[order]
        self.begin = np.searchsorted(word[order], np.arange(len(known) + 2))
        self.table = np.zeros(1 << max(16, (64 * len(self.flat)).bit_length()), bool)
        self.table[(np.repeat(np.arange(len(items)), m) * _SPREAD + self.flat) & (len(self.table) - 1)] = True
        self.in_some = np.zeros(len(known) + 1, bool)
        self.in_some[self.flat] = True

    def stretches(self, number: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, first and end word of the stretches of a chunk that can hold a copy, by text and item."""
        step, n_words, nothing = self.step, np.diff(first), len(self.known)
        n_stretches = np.maximum(1, -(-n_words // step) - 1)
        base = np.cumsum(n_stretches) - n_stretches
        text = np.repeat(np.arange(len(n_words)), n_words)
        block = (np.arange(len(number)) - first[:-1][text]) // step

        def placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Stretches and words of some places: each lies in the stretch that begins with its block, and in the one before."""
            here, before = block[at] < n_stretches[text[at]], block[at] > 0
            place = np.concatenate([(base[text[at]] + block[at])[here], (base[text[at]] + block[at] - 1)[before]])
            return place, np.concatenate([number[at][here], number[at][before]])

        seeding = self.begin[number + 1] > self.begin[number]
        place, word = np.divmod(np.unique(_pair(*placed(np.flatnonzero(seeding)), nothing + 1)), nothing + 1)
        counts = self.begin[word + 1] - self.begin[word]
        found = np.repeat(place, counts) * len(self.words) + self.item_of_seed[_ragged(self.begin[word], counts)]
        place_of, item_of = np.divmod(np.unique(found), len(self.words))
        if not len(place_of):
            return
        # The words that the stretches with a seed have of any of these items.
        total = int(n_stretches.sum())
        asked = np.zeros(total + 1, bool)
        asked[place_of] = True
        at = base[text] + block
        at = np.flatnonzero(self.in_some[number] & (asked[np.minimum(at, total)] | asked[np.maximum(at - 1, 0)]))
        place, word = np.divmod(np.unique(_pair(*placed(at), nothing + 1)), nothing + 1)
        # Different words share a column only in a large vocabulary, which keeps stretches but loses none.
        columns = min(nothing, 1 << 14)
        group = max(1, (1 << 24) // (columns + 1))
        owner = np.repeat(np.arange(len(n_words)), n_stretches)
        good = np.zeros(len(place_of), bool)
        for low in range(0, total, group):
            a, b = np.searchsorted(place, (low, low + group))
            c, d = np.searchsorted(place_of, (low, low + group))
            if c == d:
                continue
            has = np.zeros((min(group, total - low), columns), bool)
            has[place[a:b] - low, word[a:b] % columns] = True
            piece = np.cumsum(self.length[item_of[c:d]]) >> 21
            for k in np.split(np.arange(c, d), np.flatnonzero(np.diff(piece)) + 1):
                lengths = self.length[item_of[k]]
                hit = has[np.repeat(place_of[k] - low, lengths), self.flat[_ragged(self.at[item_of[k]], lengths)] % columns]
                good[k] = np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64) >= self.matches[item_of[k]]
        place_of, item_of = place_of[good], item_of[good]
        order = np.lexsort((place_of, item_of, owner[place_of]))
        place_of, item_of = place_of[order], item_of[order]
        text_of = owner[place_of]
        begin = first[text_of] + (place_of - base[text_of]) * step
        length = np.minimum(begin + 2 * step, first[text_of + 1]) - begin
        span = np.minimum(self.span[item_of], length)
        piece = np.cumsum(length) >> 20
        for k in np.split(np.arange(len(order)), np.flatnonzero(np.diff(piece)) + 1):
            # A window of the span that has words enough of the item, repeated ones as well.
            which = np.repeat(np.arange(len(k)), length[k])
            offset = _spread(length[k])
            hits = np.concatenate([[0], np.cumsum(self.may_hold(item_of[k][which], number[begin[k][which] + offset]))])
            starts = np.flatnonzero(offset <= (length[k] - span[k])[which])
            good = starts[hits[starts + span[k][which[starts]]] - hits[starts] >= self.matches[item_of[k]][which[starts]]]
            found, at = np.unique(which[good], return_index=True)
            last = np.append(at[1:], len(good))[: len(at)] - 1
            for c, a, b in zip(k[found].tolist(), offset[good[at]].tolist(), offset[good[last]].tolist(), strict=True):
                yield int(text_of[c]), int(item_of[c]), int(begin[c]) + a, int(begin[c]) + b + int(span[c])

    def may_hold(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether an item has a word; of other words very few are taken for its own, which the alignment then tells."""
        return self.table[(item * _SPREAD + word) & (len(self.table) - 1)]


def _pair(place: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
    return place * width + word


def _classes(items: list[np.ndarray], known: np.ndarray, uses: np.ndarray, least: float, size: int) -> list[_Items]:
    """The items in classes of length, each up to four times the one before."""
    m = np.array([len(h) for h in items])
    of = np.ceil(np.log2(np.maximum(m, 64) / 64) / 2).astype(int)
    return [_Items(k, [items[i] for i in k.tolist()], known, uses, enough(m[k], least, size)) for c in np.unique(of) for k in [np.flatnonzero(of == c)]]


def _aligned(classes: list[_Items], number: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """Text, item, share of the item's score, first and end word of the best alignment of each pair that scores enough."""
    for items in classes:
        near = list(items.stretches(number, first))
        scores = best_scores([number[low:high] for *_, low, high in near], [items.words[item] for _, item, *_ in near])
        good = [x for x, score in zip(near, scores.tolist(), strict=True) if score >= MATCH * items.length[x[1]] * items.share[x[1]] - 1e-6]
        for (text, item), places in groupby(good, key=lambda x: x[:2]):
            best = (0.0, 0, 0)
            for *_, low, high in places:
                score, x, y = align(number[low:high], items.words[item])
                best = max(best, (score, low + x, low + y), key=lambda t: t[0])
            if best[2] > best[1]:
                yield text, int(items.which[item]), best[0] / (MATCH * len(items.words[item])), best[1], best[2]


def _leaks_of_block(docs: DataFrame, rows: list[tuple[int, str]], size: int, least: float) -> DataFrame:
    kind = "doc_id long, item_id long, score double, first_word long, end_word long, passage string, digest string"
    items: list[tuple[int, np.ndarray]] = []
    for item_id, text in rows:
        _, (h,), *_ = words([(text or "").encode()], _TABLE)
        if len(h):
            items.append((item_id, h))
    if not items:
        return docs.sparkSession.createDataFrame([], kind)
    known = np.unique(np.concatenate([h for _, h in items]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for begin, end in chunks(texts):
                _, (h,), *_ = words(texts[begin:end], _TABLE)
                total += np.bincount(_numbers(known, h), minlength=len(total))
        has = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["word", "n"])

    uses = np.zeros(len(known), np.int64)
    for word, n in docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        uses[word] = n
    sought = docs.sparkSession.sparkContext.broadcast((known, [i for i, _ in items], _classes([h for _, h in items], known, uses, least, size)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, item_ids, classes = sought.value
        for batch in batches:
            ids, texts, found = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), []
            for begin, end in chunks(texts):
                first, (h,), starts, ends, buffer = words(texts[begin:end], _TABLE)
                number = _numbers(known, h)
                for text, item, score, low, high in _aligned(classes, number, first):
                    a = int(first[text])
                    passage = buffer[starts[low] : ends[high - 1]].decode("utf-8", "replace")
                    found.append((ids[begin + text], item_ids[item], score, low - a, high - a, passage, sha256(texts[begin + text]).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 7, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "item_id", "score", "first_word", "end_word", "passage", "digest"])

    return docs.mapInArrow(scan, kind)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 4, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, item_id, score, first_word, end_word, passage: a row per document and item it holds a copy of.

    Words are runs of letters and digits, lower-cased (A-Z). ``score`` is the best
    local alignment's share of the item's own score, ``least`` or more. Words
    count from 0, the end is exclusive.

    Every pair that scores enough is found. Of an item of fewer than ``2 * size``
    words the text must also hold a run of ``size`` words (a shorter item as a whole).

    Null or empty texts and items without words match nothing. A null doc_id comes back as null; items
    with a null id are left out. Repeated documents and items are reported one by
    one. An empty table on either side gives an empty table; other columns are not read.
    """
    return _leaks(docs, benchmark, size, least, id_col, text_col).select(outer_id(), "item_id", "score", "first_word", "end_word", "passage")


def _leaks(docs: DataFrame, benchmark: DataFrame, size: int = 4, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find_leaks`` with the stand-in for a null id, and the digest of the text that holds the copy."""
    docs = id_and_text(docs, id_col, text_col)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL")
    size_of = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size_of // BLOCK_BYTES))
    parts = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        parts.append(_leaks_of_block(docs, [tuple(r) for r in rows], size, least))
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a copy of an item; other rows of the same id, null ids too, stay."""
    leaks = _leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_leak"), F.col("digest").alias("_digest")).distinct()
    own = F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(leaks, (own[0] == leaks["_leak"]) & (own[1] == leaks["_digest"]), "left_anti")

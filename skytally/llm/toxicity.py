"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is a logistic function of the words and word beginnings in it
(of four to six bytes, as an insult has many endings), a document's the noisy-or of
its sentences' scores: 1 minus the product of their complements. As many harmless
sentences would add up, the log-odds of each are lowered by ``LENGTH`` times the
logarithm of their number. Only documents have labels; fitting the noisy-or to them
teaches the sentences, which then say where the offence is.

Words and beginnings that tell the labels apart are chosen by document counts. Fitting is by
rounds of parameter mixing: each partition of the training rows starts from the
common weights, takes a number of gradient steps on its own rows, and the results
are averaged by the partitions' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, materialise, outer_id
from .quality import held_out
from .tokens import as_bytes, byte_table, chunks, words

BUCKET_BITS = 18
_ENDS = (10, 33, 46, 63)
_SPLIT = [b for b in range(128) if not chr(b).isalnum()]
_BIAS = -7.0
_HEADS = (4, 5, 6)
#: Training rows of a part, at least.
PART_ROWS = 2000
#: How much a sentence's log-odds fall with the logarithm of the number of sentences.
LENGTH = 0.5


def _sentences(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """For each chunk: its range of texts, each feature's bucket and sentence, each sentence's text and first byte, the bytes.

    A sentence ends at one of .!? or a new line; one without words counts for nothing.
    """
    table, ends = byte_table(lower=True, seed=3, separators=_SPLIT), np.isin(np.arange(256), _ENDS)
    for begin, end in chunks(texts):
        first, hashes, starts, _, buffer = words(texts[begin:end], table, heads=_HEADS)
        stops = np.cumsum(ends[np.frombuffer(buffer, np.uint8)])
        text = np.repeat(np.arange(begin, end), np.diff(first))
        where = stops[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(where), bool)
        new[1:] = (np.diff(where) != 0) | (np.diff(text) != 0)
        buckets = np.concatenate([(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for h in hashes])
        yield begin, end, buckets, np.tile(np.cumsum(new) - 1, len(hashes)), text[new], starts[new], buffer


def _lowered(text: np.ndarray, n: int) -> np.ndarray:
    """What each sentence's log-odds are lowered by, from the text that each belongs to."""
    return LENGTH * np.log(np.maximum(np.bincount(text, minlength=n), 1))[text]


def _step(weights: np.ndarray, word: np.ndarray, sentence: np.ndarray, text: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and loss of the noisy-or likelihood; weights end with the bias."""
    z = weights[-1] - _lowered(text, len(y)) + np.bincount(sentence, weights[word], len(text))
    p = 1 / (1 + np.exp(-z))
    clear = np.bincount(text, -np.logaddexp(0, z), len(y))
    bag = np.clip(-np.expm1(clear), 1e-9, 1 - 1e-9)
    pull = np.where(y > 0, -(1 - bag) / bag, 1.0)[text] * p
    loss = -(np.where(y > 0, np.log(bag), clear)).sum()
    return np.append(np.bincount(word, pull[sentence], len(weights) - 1), pull.sum()), float(loss)


def fit(train: DataFrame, n_words: int, rounds: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the chosen words and the weights of these and of the bias, from rows (text, y)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy().astype(int)
            for _, _, word, sentence, text, *_ in _sentences(as_bytes(batch.column("text"))):
                once = np.unique((text[sentence] << BUCKET_BITS) | word)
                np.add.at(total, (y[once >> BUCKET_BITS], once & ((1 << BUCKET_BITS) - 1)), 1)
        has = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (has, total[0][has], total[1][has])], ["word", "clean", "toxic"])

    n = dict(train.groupBy("y").count().collect())
    if len(n) < 2:
        return np.zeros(0, np.int64), np.array([30.0 if 1.0 in n else -30.0])
    counts = train.mapInArrow(tally, "word long, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    ratio = F.log((F.col("t") + 0.5) / (n[1.0] + 1.0)) - F.log((F.col("c") + 0.5) / (n[0.0] + 1.0))
    telling = counts.withColumn("ratio", ratio).where("t + c >= 3").withColumn("gain", F.abs("ratio") * F.sqrt(F.col("t") + F.col("c")))
    chosen = telling.orderBy(F.desc("gain"), "word").limit(n_words).select("word", "ratio").collect()
    vocabulary = np.sort(np.array([r.word for r in chosen], np.int64))
    ratios = dict(chosen)
    weights = np.append([2 * max(0.0, ratios[int(w)]) for w in vocabulary], _BIAS)

    def mixing(start: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bags: list[tuple[np.ndarray, ...]] = []
            sentences = documents = 0
            for batch in batches:
                y = batch.column("y").to_numpy()
                for _, _, word, sentence, text, *_ in _sentences(as_bytes(batch.column("text"))):
                    at = np.searchsorted(vocabulary, word)
                    known = at < len(vocabulary)
                    known[known] = vocabulary[at[known]] == word[known]
                    bags.append((at[known], sentence[known] + sentences, text + documents, np.zeros(0)))
                    sentences += len(text)
                documents += len(y)
                bags.append((np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), y))
            if not documents:
                return
            word, sentence, text, y = (np.concatenate(x) for x in zip(*bags, strict=True))
            w, first, second = start.copy(), np.zeros(len(start)), np.zeros(len(start))
            for k in range(1, steps + 1):
                g, _ = _step(w, word.astype(int), sentence.astype(int), text.astype(int), y)
                g = g / len(y) + 1e-5 * np.append(w[:-1], 0)
                first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
                w = w - 0.2 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["n", "weights"])

        return run

    for _ in range(rounds):
        parts = train.mapInArrow(mixing(weights), "n long, weights binary").collect()
        weights = np.average([np.frombuffer(p.weights) for p in parts], axis=0, weights=[p.n for p in parts])
    return vocabulary, weights


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, left: int = 1, threshold: float = 0.7, max_rows: int = 24_000, n_words: int = 1024, rounds: int = 3, steps: int = 120, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, held_out, score, predicted and sentences, a row per document.

    ``sentences`` lists those whose own score is a half or more, in order. Labels
    are learnt from rows whose crc32(id as text) mod ``folds`` is not ``left``,
    from at most ``max_rows`` of them: those least by hash of their id. Only the
    text enters a score.

    Null or empty text: no sentence, score 0. A null id is not held out and comes
    back as null; null labels are not learnt from. Repeated ids are separate
    rows. Without labels of both kinds every document with words gets the one
    class there is. An empty table gives an empty table; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(folds, left))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    # Averaging the weights of many small parts leaves them too careful: a part has PART_ROWS rows or more.
    parts = max(1, sample.count() // PART_ROWS)
    # The id is in the hash, so that copies of one text do not meet in one part.
    train = materialise(docs.join(F.broadcast(sample), "doc_id").repartition(parts, F.xxhash64("doc_id", "text", "y")).select("text", "y"), "toxicity-train")
    vocabulary, weights = fit(train, n_words, rounds, steps)
    discard(train)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BUCKET_BITS)
        table[vocabulary] = weights[:-1]
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            scores, found = np.zeros(len(texts)), [[] for _ in texts]
            for begin, end, word, sentence, text, starts, buffer in _sentences(texts):
                z = weights[-1] - _lowered(text - begin, end - begin) + np.bincount(sentence, table[word], len(text))
                scores[begin:end] = -np.expm1(np.bincount(text - begin, -np.logaddexp(0, z), end - begin))
                for s in np.flatnonzero(z >= 0):
                    stop = min((x for x in (buffer.find(bytes([e]), starts[s]) for e in _ENDS) if x >= 0), default=len(buffer))
                    found[text[s]].append(buffer[starts[s] : stop].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(scores, 0, 1)), pa.array(found, pa.list_(pa.string()))], ["doc_id", "score", "sentences"])

    scored = docs.mapInArrow(score, "doc_id long, score double, sentences array<string>")
    return scored.select(outer_id(), held_out(folds, left).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")

"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration.

1. One pass over the texts gives each document a short vector of statistics
   (character classes, word and line repetition, lengths), written once.
2. Random Fourier features of the standardised vector approximate a Gaussian
   kernel. Each partition of the labelled rows sums its part of the normal
   equations, by fold; the sums are added up by matrix row.
3. Leaving a fold's sums out gives its rows a score that has not seen their
   labels. The ridge penalty is the one whose left-out scores are best; those
   scores, counted in bins, give the isotonic calibration.
4. The model, of a fixed size, scores every document's vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, discard, id_and_text, materialise, outer_id
from .tokens import as_bytes

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t",
    "newline": b"\n\r", "stop": b".?", "comma": b",;:", "bang": b"!", "pipe": b"|", "symbol": b"#$%&*+=<>@^_~/\\{}[]", "quote": b"\"'()-`",
}
FEATURES = (*_GROUPS, "other", "log_words", "mean_word", "long_word", "distinct", "twice", "marked", "log_lines", "same_line", "mean_line", "top_word")
FOLDS, BINS = 4, 2048
PENALTIES = (1e-1, 1.0, 1e1, 1e2)
_LOW, _HIGH = -0.5, 1.5


def _statistics(text: bytes) -> list[float]:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    parts = [counts[list(g)].sum() / n for g in _GROUPS.values()]
    w = text.split()
    k = max(1, len(w))
    lengths = np.fromiter(map(len, w), np.int64, len(w)) if w else np.zeros(1)
    tally: dict[bytes, int] = {}
    for x in w:
        tally[x] = tally.get(x, 0) + 1
    lines = text.split(b"\n")
    return [
        *parts, 1 - sum(parts), np.log1p(len(w)), lengths.mean() / 10, (lengths > 15).mean(), len(tally) / k,
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / k, sum(not (x[-1:].isalnum() or x[-1] > 127) for x in w) / k,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), max(tally.values(), default=0) / k,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """Columns doc_id and x (the statistics in the order of FEATURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([_statistics(t) for t in as_bytes(batch.column("text"))], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.directions + self.phase)
        return np.hstack([waves, np.ones((len(x), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.knots, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def isotonic(centres: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares increasing fit to binned labels (pool adjacent violators): knots and their levels."""
    blocks: list[list[float]] = []
    for c, k, s in zip(centres, n, ones, strict=True):
        blocks.append([c * k, k, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([c / k for c, k, _ in blocks]), np.array([s / k for _, k, s in blocks])


def fit(vectors: DataFrame, n_features: int = 256, width: float = 1.0, seed: int = 7) -> Model:
    """A model from labelled vectors (x, y, fold)."""
    d = len(FEATURES)
    spread = vectors.agg(*(f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)), F.count("*"), F.avg("y")).first()
    rng = np.random.default_rng(seed)
    mean, scale = np.array([v or 0.0 for v in spread[: 2 * d : 2]]), np.array([max(v or 0.0, 1e-6) for v in spread[1 : 2 * d : 2]])
    model = Model(mean, scale, rng.normal(size=(d, n_features)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if not spread[-2] or spread[-1] in (0, 1):
        model.levels[:] = 0.5 if not spread[-2] else spread[-1]
        return model
    size = n_features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z, y, fold = model.features(_matrix(batch.column("x"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in range(FOLDS):
                zf = z[fold == f]
                total[f] += zf.T @ np.hstack([zf, y[fold == f, None]])
        rows = [(f, i, total[f, i].tobytes()) for f in range(FOLDS) for i in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["fold", "i", "part"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p) for p in table.column("part").to_pylist())
        return pa.table({"fold": [key[0].as_py()], "i": [key[1].as_py()], "part": pa.array([total.tobytes()], pa.binary())})

    kind = "fold long, i long, part binary"
    parts = vectors.mapInArrow(sums, kind).groupBy("fold", "i").applyInArrow(add, kind).collect()
    equations = np.zeros((FOLDS, size, size + 1))
    for f, i, part in parts:
        equations[f, i] = np.frombuffer(part)
    whole = equations.sum(axis=0)
    solve = lambda e, p: np.linalg.solve(e[:, :size] + p * np.eye(size), e[:, size])
    left_out = np.array([[solve(whole - equations[f], p) for f in range(FOLDS)] for p in PENALTIES])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, y, fold = model.features(_matrix(batch.column("x"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for p, weights in enumerate(left_out):
                raw = (z * weights[fold]).sum(axis=1)
                at = np.clip((raw - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(int)
                n, ones, loss = np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, (raw - y) ** 2, BINS)
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), p, np.int32)), pa.array(has.astype(np.int32)), pa.array(n[has].astype(float)), pa.array(ones[has].astype(float)), pa.array(loss[has])], ["p", "at", "n", "ones", "loss"])

    binned = vectors.mapInArrow(score, "p int, at int, n double, ones double, loss double").groupBy("p", "at").agg(*(F.sum(c).alias(c) for c in ("n", "ones", "loss"))).orderBy("p", "at").toPandas()
    best = int(binned.groupby("p")["loss"].sum().idxmin())
    binned = binned[binned["p"] == best]
    centres = _LOW + (binned["at"].to_numpy() + 0.5) / BINS * (_HIGH - _LOW)
    model.knots, model.levels = isotonic(centres, binned["n"].to_numpy(), binned["ones"].to_numpy())
    model.weights = solve(whole, PENALTIES[best])
    return model


def held_out(folds: int, left: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.when(F.col(id_col) != NULL_ID, F.col(id_col)).cast("string").cast("binary")), F.lit(folds)) == left, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, left: int = 2, threshold: float = 0.7, max_rows: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, held_out, score, predicted, a row per document.

    Labels are learnt from rows whose crc32(id as text) mod ``folds`` is not
    ``left``, from about ``max_rows`` of them, by hash, if there are more. Only
    the text enters a score. Null or empty texts are scored like any other, from
    zero statistics. A null id is not held out and comes back as null; null
    labels are not learnt from. Repeated ids are separate rows. Without labels of
    both kinds every score is the share of ones (0.5 without labels). An empty
    table gives an empty table; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    vectors = materialise(statistics(docs), "statistics")
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(folds, left))
    share = min(1.0, max_rows / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The pieces of the normal equations are as many as these partitions: few, as the rows are.
    known = materialise(vectors.join(rows, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    model = fit(known.coalesce(64))
    discard(known)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.calibrated(model.features(_matrix(batch.column("x"))) @ model.weights)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = vectors.mapInArrow(score, "doc_id long, score double")
    return scored.select(outer_id(), held_out(folds, left).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Spelling variants: words that differ by one letter, by hashed deletions.

Two words differ by one inserted, deleted or replaced letter exactly if one equals the
other with a letter left out, or both are equal when the letter at the same place is
left out of each. So every word gives a key for itself and one for each letter left
out. Prefix sums of a polynomial over the letters give the keys of a block of words at
once, in 64-bit NumPy integers: the hash of what stands before a letter, and that of
what stands after it moved down by one. Keys are dealt by their leading bits, sorted
within a bucket, and those that several words share are candidates.

A hash proves nothing, so candidates meet again on the strings themselves, the word
with its letter left out. What shares such a string is counted, not paired: the words
that leave out the same place are all near each other, and the string, if it is a word,
is near all of them that are longer. So there are as many rows as letters, whatever the
number of pairs. The words at one place number at most the letters there are.

Cases: a null text has no words; a null id stands for an empty one in the hash that
picks occurrences; repeated rows count twice; other columns are ignored; without words
of the least length and number there are no rows. A run or word of any length is taken
whole; a word of n letters has n + 1 keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .tokens import _powers, byte_table, mix

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Keys of a bucket, and letters whose keys are made at once.
BUCKET, AT_ONCE = 1 << 18, 1 << 19


def occurrences(docs: DataFrame, least: int, every: int) -> DataFrame:
    """Column ``word``, a row an occurrence: runs of letters, A-Z lower-cased, one letter left out of those whose hash ``every`` divides."""
    run = F.explode(F.expr(f"regexp_extract_all(coalesce(text, ''), '{LETTERS}{{{least},}}', 0)"))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), docs["text"].alias("text")).select("id", run.alias("run"))
    rows = rows.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, _without("run", at)).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least)


def _without(word: str, at: Column) -> Column:
    """A word without the letter at a place (from 0)."""
    return F.concat(F.substring(F.col(word), F.lit(1), at), F.substring(F.col(word), at + 2, F.length(word)))


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word (a byte a letter): its own key and one for each letter left out; their words' indices and places, -1 for the whole."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    up, down = _powers.upto(len(raw) + 2)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_table(seed=11, separators=())[raw] * up[: len(raw)], out=sums[1:])
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(raw))
    before = (sums[:-1] - sums[starts[word]]) * down[starts[word]]
    after = (sums[ends[word]] - sums[1:]) * down[starts[word] + 1]
    own = (sums[ends] - sums[starts]) * down[starts]
    keys = np.concatenate([mix(own + lengths.astype(np.uint64)), mix(before + after + (lengths[word] - 1).astype(np.uint64))])
    return keys, np.concatenate([np.arange(len(words)), word]), np.concatenate([np.full(len(words), -1), at - starts[word]]).astype(np.int32)


def _emit(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            words = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
            block = np.cumsum([len(w) + 1 for w in words]) // AT_ONCE
            for piece in np.split(np.arange(len(words)), np.flatnonzero(np.diff(block)) + 1):
                keys, word, place = deletion_keys([words[k] for k in piece.tolist()])
                radix = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
                for a in range(0, len(keys), AT_ONCE):
                    b = slice(a, a + AT_ONCE)
                    yield pa.RecordBatch.from_arrays([pa.array(radix[b]), pa.array(keys[b].view(np.int64)), pa.array(ids[piece][word[b]]), pa.array(place[b])], ["radix", "key", "id", "place"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The rows of a bucket whose key several words have."""
    keys, ids = table["key"].to_numpy(), table["id"].to_numpy()
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    sizes = np.diff(np.append(begins, len(order)))
    several = np.maximum.reduceat(ids[order], begins) != np.minimum.reduceat(ids[order], begins)
    return table.take(pa.array(order[np.repeat(several, sizes)])).select(["id", "place"])


def _near(words: DataFrame) -> DataFrame:
    """Of the words (id, word, n) that have near words: how many, and the one of largest n."""
    total = words.agg(F.sum(F.length("word").cast("long") + 1)).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(total, 1) / BUCKET)), 0), 30)
    keys = words.select("id", "word").mapInArrow(_emit(bits), "radix int, key long, id long, place int")
    found = keys.groupBy("radix").applyInArrow(_shared, "id long, place int").join(words, "id")
    place = F.col("place")
    rest = F.when(place < 0, F.col("word")).otherwise(_without("word", place))
    # Leaving out any of several equal letters in a row gives one string; the first stands for all.
    leads = (place >= 0) & ((place == 0) | (F.substring(F.col("word"), place + 1, F.lit(1)) != F.substring(F.col("word"), place, F.lit(1))))
    rows = found.select("id", "place", rest.alias("rest"), leads.alias("leads"), F.struct((-F.col("n")).alias("n"), "word").alias("as_form"))
    string, same = Window.partitionBy("rest"), Window.partitionBy("rest", "place")
    ranked, whole = same.orderBy("as_form"), place < 0
    rows = rows.select(
        "id", "place", "leads",
        (F.count("*").over(same) - 1).alias("beside"),
        F.when(F.row_number().over(ranked) == 1, F.lead("as_form").over(ranked)).otherwise(F.first("as_form").over(ranked)).alias("best_beside"),
        F.min(F.when(whole, F.col("as_form"))).over(string).alias("shorter"),
        F.sum(F.col("leads").cast("long")).over(string).alias("n_longer"),
        F.min(F.when(F.col("leads"), F.col("as_form"))).over(string).alias("longer"),
    )
    shorter = F.col("leads") & F.col("shorter").isNotNull()
    n = F.when(whole, F.col("n_longer")).otherwise(F.col("beside") + shorter.cast("long"))
    best = F.when(whole, F.col("longer")).otherwise(F.least("best_beside", F.when(shorter, F.col("shorter"))))
    return rows.groupBy("id").agg(F.sum(n).alias("n_near"), F.min(best).alias("best")).where("n_near > 0")


def spelling_variants(docs: DataFrame, least: int = 7, every: int = 31, least_n: int = 2, times: int = 10) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    Words have ``least`` letters and ``least_n`` occurrences at least. A word's form is its
    near word of the largest n, the first in code-point order of equals, if that is at least
    ``times`` the word's own; its root is where following the forms ends. ``times`` is 2 at
    least, so n grows along forms and they end.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    counts = occurrences(docs, least, every).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)
    words = materialise(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    best = -F.col("best.n")
    form = best >= times * F.col("n")
    rows = words.join(_near(words), "id", "left").select(
        "word", F.when(form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, best).alias("form_n")
    )
    rows = materialise(rows, "variants")
    discard(words)
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Each step doubles how far a root is followed; n grows by `times` with each form.
    most = rows.agg(F.max("n")).first()[0] or 1
    longest, reached = math.ceil(math.log(most, times)) + 1, 1
    before = None
    while reached < longest:
        after = roots.select(F.col("word").alias("via"), F.col("root").alias("further"))
        roots = materialise(roots.join(after, roots["root"] == after["via"], "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        if before is not None:
            discard(before)
        before, reached = roots, 2 * reached
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

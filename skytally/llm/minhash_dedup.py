"""Near-duplicate groups: b-bit MinHash, a multi-index Hamming join, exact confirmation.

* A document's set is its distinct runs of ``shingle`` words. Documents with
  equal sets form one class from the start; only class representatives go on.
* The signature has ``slots`` MinHash values of 16 bits, which are indexed, and
  ``extra`` more of 8 bits; its distance is the number of slots that differ. By
  the pigeonhole principle two signatures whose indexed slots differ in
  ``distance`` or fewer have a chunk with at most ``distance // chunks`` errors.
  Each chunk is indexed once for every way to leave that many of its slots out, so
  the pair shares a key: none is lost. The extra slots sharpen the distance before
  full sets are looked at.
* Keys that several representatives share are buckets. Comparing every pair in a
  bucket would be quadratic, and is not needed for the groups. Three steps, each
  by signature and then on the full sets, with linked pairs merged in between:
  every member with the least one of its bucket; every member outside a bucket's
  largest group with the nearest one of another group; at last all members of a
  bucket that are still in different groups, each two in the first bucket they
  share. A large bucket is cut into tiles: members of its largest group go to one
  task, others to all, as two of the largest group never need comparing. A pair that
  is left out either is beyond the signature distance or is in one group already.

Two documents at the similarity bound differ in each slot with probability a
quarter. P(Bin(64, 1/4) > 30) = 4.4e-5, and with the bound of 93 of all 256 slots
6.4e-5, so about one such pair in 15,500 is missed by the signatures; pairs above
the similarity bound are missed far less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, materialise, outer_id
from .components import connected_components
from .tokens import as_bytes, byte_table, chunks, mix, window_starts, windows, words

SLOTS, DISTANCE, CHUNKS = 64, 30, 16
EXTRA, WHOLE_DISTANCE = 192, 93
#: Salts for the members that are compared with one representative.
SALTS = 64
#: Members of a bucket that are compared with as many others at a time, and pairs at once.
TILE, AT_ONCE = 1024, 1 << 17


def _shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    for begin, end in chunks(texts):
        first, (h,), *_ = words(texts[begin:end], byte_table(lower=True))
        starts, owner = window_starts(first, shingle)
        hashes = windows(h, shingle)[starts]
        cuts = np.searchsorted(owner, np.arange(end - begin + 1))
        for i in range(end - begin):
            a, b = first[i], first[i + 1]
            if 0 < b - a < shingle:
                yield windows(h[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield np.unique(hashes[cuts[i] : cuts[i + 1]])


def _signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        # Multiply-shift permutations of mixed hashes: odd factors permute the 64-bit numbers.
        np.minimum(least, (part[None, :] * seeds[:, None]).min(axis=1), out=least)
    return mix(least)


def _packed(least: np.ndarray, slots: int) -> bytes:
    return least[:slots].astype("<u2").tobytes() + least[slots:].astype(np.uint8).tobytes()


def signatures(docs: DataFrame, shingle: int = 5, slots: int = SLOTS, extra: int = EXTRA) -> DataFrame:
    """Columns doc_id, n_shingles, set_key (128-bit digest of the set, null if empty), signature."""
    seeds = np.random.default_rng(9).integers(1, 2**63, slots + extra, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, signs = [], [], []
            for s in _shingle_sets(as_bytes(batch.column("text")), shingle):
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    signs.append(None)
                    continue
                x = mix(s)
                keys.append(np.array([x.sum(), mix(x ^ np.uint64(len(s))).sum()], np.uint64).tobytes())
                signs.append(_packed(_signature(x, seeds), slots))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _masks(slots: int, n_chunks: int, distance: int) -> list[list[int]]:
    """The slots of each key: every chunk, with every choice of as many of its slots as may be in error left out."""
    errors = distance // n_chunks
    return [[int(x) for x in kept] for part in np.array_split(np.arange(slots), n_chunks) for kept in combinations(part, max(1, len(part) - errors))]


def chunk_keys(reps: DataFrame, masks: list[list[int]]) -> DataFrame:
    """A row (rep, mask, key) for each key of each signature."""
    value = lambda slot: F.substring("signature", 2 * slot + 1, 2)
    keys = F.array(*(F.xxhash64(F.lit(i), *(value(s) for s in kept)) for i, kept in enumerate(masks)))
    return reps.select("rep", F.posexplode(keys).alias("mask", "key"))


class _Signatures:
    """Signatures of a batch, compared row by row."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, slots: int) -> None:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        self.indexed = np.ascontiguousarray(raw[:, : 2 * slots]).view("<u2")
        self.extra = np.ascontiguousarray(raw[:, 2 * slots :])

    def near(self, i: np.ndarray, j: np.ndarray, distance: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs of rows (i, j) that are within both distances, and how far apart they are."""
        own = (self.indexed[i] != self.indexed[j]).sum(axis=1)
        ok = own <= distance
        i, j, own = i[ok], j[ok], own[ok]
        far = own + (self.extra[i] != self.extra[j]).sum(axis=1)
        return i[far <= whole], j[far <= whole], far[far <= whole]


def near_pairs(pairs: DataFrame, reps: DataFrame, slots: int, distance: int, whole: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures are within the distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_Signatures(batch.column(c), slots) for c in ("sign_a", "sign_b"))
                own = (a.indexed != b.indexed).sum(axis=1)
                near = pa.array((own <= distance) & (own + (a.extra != b.extra).sum(axis=1) <= whole))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    signs = reps.select("rep", "signature")
    both = pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b")
    return both.mapInArrow(run, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition in tables that cut no (key, p, q) in two."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        names = [table.column(c).to_numpy() for c in ("key", "p", "q")]
        last = int(np.flatnonzero(np.any([x != x[-1] for x in names], axis=0))[-1:].sum() + 1) if any((x != x[-1]).any() for x in names) else 0
        before = held[-1] if held else None
        if before is not None and last == 0 and all(before.column(c)[-1] == table.column(c)[-1] for c in ("key", "p", "q")):
            held.append(table)
            continue
        done = [*held, table.slice(0, last)]
        held = [table.slice(last)]
        done = pa.concat_tables(done)
        if done.num_rows:
            yield done
    if held:
        yield pa.concat_tables(held)


def _between_groups(table: pa.Table, slots: int, distance: int, whole: int, masks: list[list[int]] | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one tile pair (key, p, q) that are in different groups and within the distances.

    Without ``masks``, for each i outside its bucket's largest group the nearest j
    only; with them, all for which the bucket's key is the first that the two share.
    """
    signs = _Signatures(table.column("signature"), slots)
    key, p, q, tile, group, mask, main = (table.column(c).to_numpy() for c in ("key", "p", "q", "tile", "group", "mask", "main"))
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)
    ends = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
    counts = ends - np.arange(len(key)) - 1
    sums, low, found = np.cumsum(counts), 0, [np.zeros((3, 0), np.int64)]
    # Which slots each mask keeps, as bits.
    bits = np.array([sum(1 << s for s in m) for m in masks], np.uint64) if masks is not None else None
    while low < len(key):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + AT_ONCE, "right")))
        i = np.repeat(np.arange(low, high), counts[low:high])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts[low:high]) - counts[low:high], counts[low:high])
        low = high
        ok = (group[i] != group[j]) & ((p[i] == q[i]) | (tile[i] != tile[j]))
        i, j, far = signs.near(i[ok], j[ok], distance, whole)
        if bits is not None and len(i):
            same = np.zeros((len(i), 64), bool)
            same[:, :slots] = signs.indexed[i] == signs.indexed[j]
            same = np.packbits(same, axis=1, bitorder="little").view("<u8").ravel()
            fresh = np.ones(len(i), bool)
            for m, own in enumerate(bits):
                fresh &= (mask[i] <= m) | (same & own != own)
            i, j, far = i[fresh], j[fresh], far[fresh]
        found.append(np.stack([np.where(main[i], j, i), np.where(main[i], i, j), far]))
    i, j, far = np.concatenate(found, axis=1)
    if masks is None:
        order = np.lexsort((j, far, i))
        i, j = i[order], j[order]
        first = np.ones(len(i), bool)
        first[1:] = np.diff(i) != 0
        i, j = i[first], j[first]
    return i, j


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs whose full sets have 100 * intersection >= percent * union.

    A pair's second text goes to its first; the rows of one ``a`` are salted, and
    each salt gets the text of ``a`` once.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    sides = texts.withColumnRenamed("doc_id", "b")
    left = salted.join(sides, "b").select("a", "salt", "b", "text")
    heads = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(left).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_key = np.zeros(0, np.uint64), None
        for batch in batches:
            left_, right_ = [], []
            sets = _shingle_sets(as_bytes(batch.column("text")), shingle)
            for a, salt, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), sets, strict=True):
                if b is None:
                    head, head_key = s, (a, salt)
                    continue
                if head_key != (a, salt):
                    raise ValueError("a pair came before its first text")
                common = len(np.intersect1d(head, s, assume_unique=True))
                if 100 * common >= percent * (len(head) + len(s) - common):
                    left_.append(a)
                    right_.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left_, pa.int64()), pa.array(right_, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, slots: int = SLOTS, distance: int = DISTANCE, n_chunks: int = CHUNKS, extra: int = EXTRA, whole_distance: int = WHOLE_DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept, a row per document.

    Documents are linked if 100 * intersection >= percent * union of their sets
    of lower-cased (A-Z) word runs; ``component_id`` is the least id that links
    reach, ``kept`` says that it is the document's own.

    Null or empty text, or white space only: an empty set, linked with nothing.
    Fewer words than a shingle: the whole sequence is the one shingle. A null id
    counts as larger than any other and comes back as null. Rows that repeat an
    id are taken as separate rows of that id. An empty table gives an empty
    table; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    masks = _masks(slots, n_chunks, distance)
    sets = materialise(signatures(docs, shingle, slots, extra), "signatures")
    classes = sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    reps = materialise(classes, "classes")
    keys = chunk_keys(reps, masks)
    shared = keys.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head <> last").select("key", "head")
    members = materialise(keys.join(shared, "key"), "buckets")
    stars = members.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialise(confirm(near_pairs(stars, reps, slots, distance, whole_distance), docs, shingle, percent), "links")
    groups = connected_components(links)
    within = (slots, distance, whole_distance)
    pairs = materialise(nearest_pairs(members, reps, groups, within), "pairs")
    links = links.unionByName(materialise(confirm(pairs, docs, shingle, percent), "links"))
    discard(groups)
    groups = connected_components(links)
    links = links.unionByName(materialise(remaining_links(members, reps, groups, docs, within, masks, shingle, percent), "links"))
    discard(groups)
    groups = connected_components(links)
    for spent in (members, pairs, links):
        discard(spent)
    merged = reps.select("set_key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("group", "rep").alias("component_id"))
    return with_class(sets.select("doc_id", "n_shingles", "set_key"), merged)


def open_buckets(members: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one group, with signature and group, by tile pair (p, q).

    Members of the largest group have tiles of their own, which only meet those of
    the others; the others' tiles meet each other as well.
    """
    labelled = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    counts = labelled.groupBy("key", "group").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", (-F.col("group")).alias("group"))).alias("top"), F.sum("n").alias("all"), F.count("*").alias("groups")).where("groups > 1")
    tiles = mixed.select("key", (-F.col("top.group")).alias("largest"), F.ceil(F.col("top.n") / TILE).alias("m"), F.ceil((F.col("all") - F.col("top.n")) / TILE).alias("u"))
    rows = labelled.join(tiles, "key").withColumn("main", F.col("group") == F.col("largest"))
    tile = F.when(F.col("main"), F.pmod(F.xxhash64("rep"), "m")).otherwise(F.col("m") + F.pmod(F.xxhash64("rep"), "u"))
    other = F.explode(F.sequence(F.when(F.col("main"), F.col("m")).otherwise(F.lit(0).cast("long")), F.col("m") + F.col("u") - 1))
    rows = rows.withColumn("tile", tile).withColumn("other", other)
    rows = rows.select("key", "mask", "rep", "group", "main", "tile", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"))
    return rows.join(reps.select("rep", "signature"), "rep").select("key", "p", "q", "mask", "tile", "rep", "group", "main", "signature")


_OPEN = "key long, p long, q long, mask int, tile long, rep long, group long, main boolean, signature binary"


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def nearest_pairs(members: DataFrame, reps: DataFrame, groups: DataFrame, within: tuple[int, int, int]) -> DataFrame:
    """Pairs (a, b): in each open bucket, the nearest of another group for every member outside the largest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            rep = table.column("rep").to_numpy()
            i, j = _between_groups(table, *within, None)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], ["a", "b"])

    return _by_tile(open_buckets(members, reps, groups)).mapInArrow(run, "a long, b long").distinct()


def remaining_links(members: DataFrame, reps: DataFrame, groups: DataFrame, texts: DataFrame, within: tuple[int, int, int], masks: list[list[int]], shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between all members of open buckets that are in different groups.

    The pairs themselves are never rows: first each bucket says which of its
    members have one, then these get their texts and are compared where they meet.
    """

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            use = np.zeros(table.num_rows, bool)
            for side in _between_groups(table, *within, masks):
                use[side] = True
            yield from table.filter(pa.array(use)).to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            rep, sets, found = table.column("rep").to_numpy(), list(_shingle_sets(as_bytes(table.column("text")), shingle)), []
            for i, j in zip(*(x.tolist() for x in _between_groups(table, *within, masks)), strict=True):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    found.append((rep[i], rep[j]))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    rows = _by_tile(open_buckets(members, reps, groups)).mapInArrow(needed, _OPEN)
    with_text = rows.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    return _by_tile(with_text).mapInArrow(linked, "a long, b long").distinct()


def with_class(sets: DataFrame, merged: DataFrame) -> DataFrame:
    """Each document with its class's component; a class that holds a thousandth of the rows or more is joined by broadcast."""
    least = max(2, -(-sets.count() // 1000))
    hot = F.broadcast(sets.where("set_key IS NOT NULL").groupBy("set_key").count().where(F.col("count") >= least).join(merged, "set_key").drop("count"))
    found = sets.join(hot, "set_key", "left")
    cold = found.where("component_id IS NULL").drop("component_id").join(merged, "set_key", "left")
    out = found.where("component_id IS NOT NULL").unionByName(cold).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(outer_id(), "n_shingles", outer_id("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))

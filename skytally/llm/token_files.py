"""Token ids of documents in binary shards, each a wavelet matrix in one compressed file.

Documents are dealt over shards in ascending order of their ids, so that a shard is a
range of ids; equal or null ids (nulls come last) are told apart by a hash of the text,
so no id makes a shard grow. A shard is one Parquet file of few rows, a row a segment of
whole documents of about ``segment_bytes`` of text:

    shard int, segment int     place of the segment
    first long, n_tokens long  ids of the shard before it, and its own
    doc_ids, ends array<long>  its documents and the end of each one's ids, end id included
    zeros array<long>, planes array<binary>, ranks array<binary>   the wavelet matrix

Spark commits the files, so a task that is lost leaves none behind, and whatever Spark
can write to will do for a folder. ``read_tokens`` gives back every document's ids;
``token_at``, ``count_tokens`` and ``find_tokens`` answer from the same files by rank
and select, without putting the ids together again.

A byte-level vocabulary cuts a text before a single space between two characters that
are no spaces, whatever stands around, and after a run of letters; so the library encodes
the pieces between such places by themselves, and a distinct one again only if its task
has met half a million others since. With any other kind of tokenizer whole texts are
encoded. Cases: a null text is empty, an empty one has the end id alone; a
text longer than a segment is a segment of its own; repeated rows are documents of their
own; an empty table gives an empty folder, and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_and_text, outer_id, shared_dir
from .wavelet import WaveletMatrix

TOKENIZER = "byte_bpe_50k.json"
SEGMENT = "shard int, segment int, first long, n_tokens long, doc_ids array<long>, ends array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"
#: Shards are numbered in groups of so many when the ids before each are added up.
GROUP = 1024
#: Up to so many shards (16 bytes each) their starts are broadcast.
BROADCAST = 1_000_000


#: A part is a word of letters and the rest from an ASCII character on that is none, between which tokens end; those of Latin-1 are enough here.
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"
_CUT = rf"(?s)^(?P<word>[{_LETTERS}]+)(?P<rest>(?:[\x{{00}}-@\[-`{{-\x{{7F}}].*)?)$"
#: Words that are encoded in one text, and parts that a task keeps.
JOINED, KEPT = 300, 1 << 20


class _Encoder:
    """A tokenizer with the ids of the parts (what stands between single spaces) that its task has met."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.codec = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        rule, added = repr(self.codec.pre_tokenizer), self.codec.get_added_tokens_decoder().values()
        byte_level = self.codec.normalizer is None and rule.startswith("ByteLevel(") and "add_prefix_space=False" in rule and "use_regex=True" in rule
        #: Whether texts may be cut before single spaces.
        self.cuts = byte_level and not any(any(c.isspace() for c in t.content) or t.lstrip or t.rstrip for t in added)
        self.width = max(self.codec.get_vocab().values()).bit_length()
        self.forget()

    def forget(self) -> None:
        #: Ids of pieces, one after another, and how many each has; row 0 is empty.
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        #: The pieces met, words and others, and their rows; the parts met, and the rows of each one's two pieces.
        self.words, self.others = (_Met(), _Met())
        self.known = pa.array([], pa.large_string())
        self.heads, self.tails = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.opens, self.closes = np.zeros(0, bool), np.zeros(0, bool)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has."""
        ids, lengths = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        # What the library returns is many times the ids; few texts at once keep it small.
        for k in range(0, len(texts), JOINED):
            found = [e.ids for e in self.codec.encode_batch(texts[k : k + JOINED], add_special_tokens=False)]
            lengths[k : k + JOINED] = list(map(len, found))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        return np.concatenate(ids), lengths

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of a space and each word of letters; many are encoded in one text and told apart by the tokens' words."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), JOINED):
            e = self.codec.encode(" " + " ".join(words[k : k + JOINED]), add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            lengths.append(np.bincount(e.word_ids))
        return np.concatenate(ids), np.concatenate(lengths)

    def _rows(self, met: _Met, pieces: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The rows of pieces, with those not met before encoded first."""
        coded = pieces.dictionary_encode()
        at = pc.index_in(coded.dictionary, met.known)
        new = at.is_null()
        unmet = coded.dictionary.filter(new)
        at = at.fill_null(0).to_numpy()
        if len(unmet):
            ids, lengths = encode(unmet.to_pylist())
            at = at.copy()
            at[new.to_numpy(zero_copy_only=False)] = np.arange(len(met.known), len(met.known) + len(unmet))
            met.known = pa.concat_arrays([met.known, unmet])
            met.rows = np.append(met.rows, np.arange(len(self.lengths), len(self.lengths) + len(unmet), dtype=np.int32))
            self.flat, self.lengths = np.append(self.flat, ids), np.append(self.lengths, lengths)
        return met.rows[at][coded.indices.to_numpy()]

    def parts(self, found: pa.Array) -> np.ndarray:
        """Places of distinct parts in the tables."""
        at = pc.index_in(found, self.known)
        new = at.is_null()
        unmet = found.filter(new)
        at = at.fill_null(0).to_numpy()
        if len(unmet):
            at = at.copy()
            at[new.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(unmet))
            cut = pc.extract_regex(unmet, _CUT)
            plain = cut.is_null().to_numpy(zero_copy_only=False)
            heads, tails = np.zeros(len(unmet), np.int32), np.zeros(len(unmet), np.int32)
            whole = unmet.filter(pa.array(plain))
            heads[plain] = self._rows(self.others, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), whole, pa.scalar(" ", pa.large_string())), self.ids)
            split = cut.filter(pa.array(~plain))
            heads[~plain] = self._rows(self.words, split.field("word"), self._spaced)
            tails[~plain] = self._rows(self.others, split.field("rest"), self.ids)
            self.heads, self.tails = np.append(self.heads, heads), np.append(self.tails, tails)
            white = lambda at, end: pc.or_(pc.utf8_is_space(pc.utf8_slice_codeunits(unmet, at, end)), pc.equal(pc.binary_length(unmet), 0)).to_numpy(zero_copy_only=False)
            self.opens, self.closes = np.append(self.opens, white(0, 1)), np.append(self.closes, white(-1, None))
            self.known = pa.concat_arrays([self.known, unmet])
        return at


class _Met:
    """Pieces that have been encoded, and their rows."""

    def __init__(self) -> None:
        self.known, self.rows = pa.array([], pa.large_string()), np.zeros(0, np.int32)


@lru_cache(maxsize=2)
def _encoder(name: str) -> _Encoder:
    return _Encoder(name)


def _ragged(flat: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists that ``flat`` holds one after another, put after each other as ``order`` says, and the length of each."""
    starts = np.cumsum(lengths) - lengths
    taken = lengths[order]
    return flat[np.arange(int(taken.sum())) + np.repeat(starts[order] - (np.cumsum(taken) - taken), taken)], taken


def encode(texts: pa.Array, tokenizer: str = TOKENIZER, end_id: int | None = 2) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another and each followed by the end id, and the end of each text's."""
    encoder, n = _encoder(tokenizer), len(texts)
    texts = texts.cast(pa.large_string())
    after = [] if end_id is None else [end_id]
    if not encoder.cuts:
        flat, lengths = encoder.ids(texts.to_pylist())
        ends = np.cumsum(lengths)
        return np.insert(flat, np.repeat(ends, len(after)), after * n), ends + len(after) * np.arange(1, n + 1)
    if len(encoder.known) > KEPT:
        encoder.forget()
    lists = pc.split_pattern(texts, " ")
    bounds, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
    names = coded.indices.to_numpy()
    part = encoder.parts(coded.dictionary)[names]
    # A piece begins with each text, and with each part if neither side of its space is white.
    begins = np.ones(len(part), bool)
    begins[1:] = ~encoder.opens[part[1:]] & ~encoder.closes[part[:-1]]
    begins[bounds[:-1]] = True
    first = np.zeros(len(part), bool)
    first[bounds[:-1]] = True
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(part))
    plain = (ends - at == 1) & ~first[at]
    others = [("" if lead else " ") + " ".join(coded.dictionary.take(pa.array(names[a:b])).to_pylist()) for a, b, lead in zip(at[~plain].tolist(), ends[~plain].tolist(), first[at[~plain]].tolist(), strict=True)]
    own, own_lengths = encoder.ids(others)
    # Two rows a piece: head and tail, or its own and an empty one; the end id follows each text.
    order = np.zeros(2 * len(at), np.int64)
    order[0::2][plain], order[1::2][plain] = encoder.heads[part[at[plain]]], encoder.tails[part[at[plain]]]
    order[0::2][~plain] = len(encoder.lengths) + np.arange(len(others))
    per_text = 2 * np.searchsorted(at, bounds[1:])
    lengths = np.concatenate([encoder.lengths, own_lengths, [len(after)]])
    flat = np.concatenate([encoder.flat, own, np.array(after, np.uint32)])
    out, taken = _ragged(flat, lengths, np.insert(order, per_text, len(lengths) - 1))
    return out, np.cumsum(taken)[per_text + np.arange(n)]


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of documents that come to about ``size`` bytes; a longer text is by itself."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).to_numpy()
        begin = 0
        for k, length in enumerate(lengths.tolist()):
            if total and total + length > size:
                held.append(batch.slice(begin, k - begin))
                yield _joined(held)
                held, begin, total = [], k, 0
            total += length + 1
        held.append(batch.slice(begin))
    if total:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    columns = [pa.concat_arrays([b.column(k).cast(t) for b in held]) for k, t in ((0, pa.int64()), (1, pa.large_string()))]
    return columns[0], columns[1]


def _write_shard(tokenizer: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first = TaskContext.get().partitionId(), 0
        width = max(end_id.bit_length(), _encoder(tokenizer).width)
        for segment, (doc_ids, texts) in enumerate(_segments(batches, size)):
            ids, ends = encode(texts, tokenizer, end_id)
            matrix = WaveletMatrix.build(ids.astype(np.uint16) if width <= 16 else ids, width)
            row = [shard, segment, first, len(ids), doc_ids, ends, matrix.zeros, [p.tobytes() for p in matrix.planes], [r.tobytes() for r in matrix.ranks]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            names = [f.split()[0] for f in SEGMENT.split(", ")]
            yield pa.RecordBatch.from_arrays([_cell(v, t) for v, t in zip(row, types, strict=True)], names)
            first += len(ids)

    return run


def _cell(value, kind: pa.DataType) -> pa.Array:
    """A column of one row."""
    if isinstance(value, pa.Array | np.ndarray):
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value, kind.value_type))
    return pa.array([value], kind)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 2, shard_bytes: int = 32 << 20, segment_bytes: int = 4 << 20) -> None:
    """Write the ids of every whole text to ``path``, shard by shard in ascending order of ``doc_id``.

    Texts go through one shuffle, by ranges of ids; each task encodes one shard, a segment
    at a time.
    """
    rows = id_and_text(docs)
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    lanes = min(docs.sparkSession.sparkContext.defaultParallelism, total >> 20)
    order = ["doc_id", F.xxhash64("text"), "text"]
    shards = rows.repartitionByRange(max(-(-total // shard_bytes), lanes, 1), "doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    shards.mapInArrow(_write_shard(tokenizer, end_id, segment_bytes), SEGMENT).write.option("compression", "zstd").parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``base``, the number of ids before them in all shards."""
    files = spark.read.schema(SEGMENT).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.floor(F.col("shard") / GROUP))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).select("part", so_far(Window.orderBy("part")).alias("before"))
    starts = shards.withColumn("within", so_far(Window.partitionBy("part").orderBy("shard"))).join(parts, "part").select("shard", (F.col("before") + F.col("within")).alias("base"))
    known = files.agg(F.max("shard")).first()[0] or 0
    return files.join(F.broadcast(starts) if known < BROADCAST else starts, "shard").withColumn("base", F.col("base") + F.col("first"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, WaveletMatrix]]:
    """First position, documents, their ends and the matrix of each segment of columns base, n_tokens, doc_ids, ends, zeros, planes, ranks."""
    for batch in batches:
        for k in range(batch.num_rows):
            base, n = (batch.column(c)[k].as_py() for c in (0, 1))
            docs, ends = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
            yield base, docs, ends, WaveletMatrix(n, batch.column(5)[k].as_py(), batch.column(4)[k].as_py(), batch.column(6)[k].as_py())


_ASKED = ("base", "n_tokens", "doc_ids", "ends", "zeros", "planes", "ranks")


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, docs, ends, matrix in _matrices(batches):
            ids = matrix.all().astype("<u4")
            begins = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(docs), pa.array(base + begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """A row per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return _files(spark, path).select(*_ASKED).mapInArrow(_decode(ids), schema).withColumn("doc_id", outer_id())


def token_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """The id and the document at each position of the whole sequence; a position beyond it has no row."""
    asked = np.unique(np.array(positions, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, docs, ends, matrix in _matrices(batches):
            at = asked[(asked >= base) & (asked < base + matrix.n)]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(matrix.access(at - base)), pa.array(docs[np.searchsorted(ends, at - base, side="right")])], ["position", "id", "doc_id"])

    inside = F.lit(False)
    if len(asked):
        inside = (F.col("base") <= int(asked[-1])) & (F.col("base") + F.col("n_tokens") > int(asked[0]))
    return _files(spark, path).where(inside).select(*_ASKED).mapInArrow(run, "position long, id long, doc_id long").withColumn("doc_id", outer_id())


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """How often each of some ids occurs, and in how many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ends, matrix in _matrices(batches):
            per = [np.diff(matrix.rank(t, np.concatenate([[0], ends]))) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([int(c.sum()) for c in per], pa.int64()), pa.array([int((c > 0).sum()) for c in per], pa.int64())], ["id", "n", "n_docs"])

    return _files(spark, path).select(*_ASKED).mapInArrow(run, "id long, n long, n_docs long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def find_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """A row for each occurrence of some ids: id, position, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, docs, ends, matrix in _matrices(batches):
            for t in tokens:
                at = matrix.select(t)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int64()), pa.array(base + at), pa.array(docs[np.searchsorted(ends, at, side="right")])], ["id", "position", "doc_id"])

    return _files(spark, path).select(*_ASKED).mapInArrow(run, "id long, position long, doc_id long").withColumn("doc_id", outer_id())


def token_folder(spark: SparkSession) -> str:
    """A new folder among the shared ones."""
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

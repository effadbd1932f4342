"""A document-cleaning pipeline of five of the text operators.

Each stage takes what the one before kept, written as Parquet and read again, and
returns the columns of ``documents``; the last returns the encoded documents.
A document is a row: null ids and ids with several texts are told apart within a stage;
only rows of equal id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm.common import discard, materialise
from skytally.llm.decontamination import decontaminate
from skytally.llm.line_dedup import dedup_lines
from skytally.llm.minhash_dedup import near_duplicates
from skytally.llm.pieces import encode_pieces
from skytally.llm.quality import score_quality
from skytally.session import ship_package


def _by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``doc_id`` that is never null and of one text, in the order of the ids, nulls last; the id itself is ``_doc_id``."""
    n, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == distinct:
        return docs.withColumn("_doc_id", F.col("doc_id"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select("doc_id", digest.alias("_digest")).distinct().orderBy(F.asc_nulls_last("doc_id"), "_digest")
    keys = materialise(rows.select(F.col("doc_id").alias("_doc_id"), "_digest", F.monotonically_increasing_id().alias("_row")), "row-ids")
    # The digest leads the join, so that null ids do not meet in one task.
    found = docs.withColumn("_own", digest).join(keys, (F.col("_own") == F.col("_digest")) & docs["doc_id"].eqNullSafe(F.col("_doc_id")))
    return materialise(found.withColumn("doc_id", F.col("_row")).drop("_own", "_digest", "_row"), "rows")


def _with_ids(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("_doc_id")).select(*docs.columns)


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    return rows.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship_package(spark)
    rows, labels = _by_row(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = rows.select("doc_id", "_doc_id").distinct().join(labels.withColumnRenamed("doc_id", "_doc_id"), "_doc_id").drop("_doc_id")
    return _with_ids(_without(rows, score_quality(rows, own).where("predicted = 0")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document, or the same one, already has go; every document stays."""
    ship_package(spark)
    rows = _by_row(docs)
    lines = dedup_lines(rows).select("doc_id", F.col("text").alias("_text")).distinct()
    joined = rows.join(lines, "doc_id").withColumns({"text": F.col("_text"), "n_chars": F.length("_text").cast("long")})
    return _with_ids(joined, docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id."""
    ship_package(spark)
    rows = _by_row(docs)
    return _with_ids(_without(rows, near_duplicates(rows).where("NOT kept")).dropDuplicates(["doc_id"]), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    ship_package(spark)
    return _with_ids(decontaminate(_by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns doc_id, ids, n_pieces and text, which is decoded from the ids."""
    ship_package(spark)
    return encode_pieces(docs).withColumnRenamed("decoded", "text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: A kernel classifier and a segmentation have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if k:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

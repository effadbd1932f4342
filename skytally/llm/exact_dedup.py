"""Exact de-duplication: which document of each group of equal texts stays.

Skew-safe combining in three steps, each grouping by the full text and not by
the digest alone:

1. each input partition combines its equal texts (the partial aggregate that
   Spark runs before a shuffle);
2. the partitions' winners meet by digest and a salt taken from the partition,
   so that a group of copies that fills a third of the table is spread out;
3. the salts' winners, a few for each text, are combined globally.

Membership then comes from the digests. Groups that hold a thousandth of the
rows or more, at most a thousand of them, are joined by broadcast, so no task
gets one group's rows; the rest by shuffle. Where texts of equal digest differ,
the rows are joined by text as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, outer_id

SALTS = 16
HOT_PARTS = 1000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept and digest, a row per document.

    Of rows with identical text the one with the largest id stays. A null text
    counts as empty. A null id counts as larger than any other and comes back as
    null. Rows that repeat id and text are one group, and each is marked kept if
    its id is. An empty table gives an empty table; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    local = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Only what decides goes on from the salts: the text is looked at again where more than one salt, or more than one text, has the digest.
    groups = local.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    classes = groups.groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
        F.sum("group_size").alias("digest_rows"),
    )
    classes = materialise(classes, "exact-classes")
    members = rows.select("doc_id", "digest")
    plain = classes.where("texts = 1").drop("texts", "digest_rows")
    least = max(2, -(-docs.count() // HOT_PARTS))
    hot, cold = plain.where(F.col("group_size") >= least), plain.where(F.col("group_size") < least)
    found = members.join(F.broadcast(hot), "digest", "left")
    out = found.where("keep_id IS NOT NULL").unionByName(found.where("keep_id IS NULL").select("doc_id", "digest").join(cold, "digest"))
    clashing = classes.where("texts > 1").select("digest")
    if not clashing.isEmpty():
        texts = groups.join(clashing, "digest", "left_semi")
        out = out.unionByName(rows.join(texts, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size"))
    return out.select(outer_id(), outer_id("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "digest")

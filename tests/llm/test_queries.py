"""The registered queries and the pipeline's stages on the smallest tables."""

from __future__ import annotations

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skytally.llm import queries
from skytally.llm.decontamination import _SPLIT

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op2_quality_classifier": {"doc_id", "held_out", "score", "predicted"}, "op3_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op4_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op5_decontamination": {"doc_id", "item_id"}, "op6_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op8_line_dedup": {"doc_id"}, "op9_minhash_dedup": {"doc_id", "n_shingles", "component_id", "kept"}, "op10_piece_encoding": {"doc_id", "ids"},
    "op11_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"}, "op12_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op13_centroid_clustering": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    assert set(queries.QUERIES[name](spark, FOLDER).columns) >= COLUMNS[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame, relation = queries.QUERIES[name](spark, FOLDER), duck.sql(queries.ORACLES[name])
    columns = sorted(relation.columns)
    assert sorted(frame.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == sorted(relation.select(*columns).fetchall(), key=str)


def _item_words(text):
    return "".join(" " if ord(c) in _SPLIT else c for c in (text or "").translate(brute.LOWER)).split()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage is given and returns, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(k)))
        after = spark.read.parquet(str(folder / str(k)))
        out.append((docs, after))
        docs = after
    return out


def _texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_stage_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_stage_quality(spark, stages):
    before, after = map(_texts, stages[0])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in before]
    bad = [i for i, q in labels.items() if q == 0 and i in before]
    assert sum(i in after for i in good) >= 0.9 * len(good) and sum(i not in after for i in bad) >= 0.8 * len(bad)
    assert after.items() <= before.items()


def test_stage_lines(stages):
    before, after = map(_texts, stages[1])
    assert after == {i: x[2] for i, x in brute.lines(list(before.items())).items()}


def test_stage_near(stages):
    before, after = map(_texts, stages[2])
    assert after == {i: before[i] for i, (_, top) in brute.near_groups(list(before.items())).items() if top == i}


def test_stage_leaks(spark, stages):
    before, after = map(_texts, stages[3])
    items = [_item_words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaking = set()
    for i, text in before.items():
        w = _item_words(text)
        for item in items:
            if len(set(item) & set(w)) >= 0.4 * len(set(item)) and brute.alignment(w, item) >= len(item):
                leaking.add(i)
    assert set(before) - set(after) == leaking


def test_stage_pieces(stages):
    before, after = map(_texts, stages[4])
    assert after == {i: t or "" for i, t in before.items()}


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == stages[-1][1].count()


def test_stages_tell_rows_apart(spark, table, tmp_path):
    """Null ids, and an id with two texts, are documents of their own in every stage."""
    item = [f"item{k}" for k in range(20)]
    own = lambda tag: " ".join(f"{tag}{k}" for k in range(30))
    rows = [(None, own("a")), (None, own("b")), (None, own("c") + "\n" + own("d")), (4, own("d")), (4, own("e")), (5, own("f")), (6, own("f") + " end"), (None, own("g") + " " + " ".join(item)), (None, own("f") + " too")]
    docs = table(rows).withColumn("source", F.substring("text", 1, 1))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def got(frame):
        assert frame.columns == docs.columns
        return sorted(((r.doc_id, r.text, r.source) for r in frame.collect()), key=str)

    given = [(i, t, t[0]) for i, t in rows]
    lines = got(corpus_pipeline.line_dedup(spark, docs, str(tmp_path)))
    assert lines == sorted([(i, own("c") if t[0] == "c" else "" if t.endswith((" end", " too")) else t, t[0]) for i, t in rows], key=str)
    near = got(corpus_pipeline.minhash_dedup(spark, docs, str(tmp_path)))
    assert near == sorted([x for x in given if not x[1].endswith((" end", " too"))], key=str)
    clean = got(corpus_pipeline.decontamination(spark, docs, str(tmp_path)))
    assert clean == sorted([x for x in given if x[2] != "g"], key=str)
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mixed = plain.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    kept = {r.text for r in corpus_pipeline.quality_classifier(spark, mixed, str(tmp_path)).where("doc_id IS NULL").collect()}
    assert 0 < len(kept) < mixed.where("doc_id IS NULL").select("text").distinct().count()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0

"""The pipeline against a plain Python version of each stage, and the queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meteorium.llm.queries import QUERIES
from tools import check

from .helpers import FOLDER
from .test_index import brute as hits
from .test_near import brute as near


def test_each_stage_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("score", F.lit(1)).withColumn("id", F.lit("clash"))
    docs = docs.unionByName(docs.limit(2).withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.lit("12 34 !?")))
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if name != "packing":
            assert after.columns == docs.columns
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "language_id":
            want = {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_copies":
            want = set({t or "": i for i, t in sorted(before.items())}.values())
        elif name == "near_copies":
            want = {i for i, _, c in near(list(before.items()), 5, 80) if i == c}
        elif name == "benchmark_passages":
            want = {i for i, _, h, _ in hits(list(before.items()), items) if not h}
        else:
            want = {i for i, t in before.items() if (t or "").split()}
        assert kept == want, name
        docs = after


def test_language_stage_goes_by_evidence(spark):
    known = [(k, "the old house stands near the river and the mill", "en") for k in range(20)]
    odd = [(100, "чужой язык совсем другой", None), (101, "12 34", None), (102, None, None), (103, "house чужой", None), (104, "the mills", None)]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(known + odd, schema)
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, FOLDER).collect()} == {*range(20), 103, 104}
    unlabelled = spark.createDataFrame([(i, t, None) for i, t, _ in known + odd], schema)
    assert corpus_pipeline.language_id(spark, unlabelled, FOLDER).count() == 25  # nothing can be told, so all stay


def test_stages_leave_no_files_behind(spark, monkeypatch, tmp_path):
    import os

    from meteorium import session
    before = set(session.scratch_paths())
    result = corpus_pipeline.run(spark, FOLDER)
    assert result.count() > 0
    left = [p for p in session.scratch_paths() if p not in before]
    assert len(left) == 1 and all(os.path.exists(p.removeprefix("file:")) for p in left)  # the last stage's result


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    query, sql = QUERIES[name]
    problem, _ = check.compare(query(spark, FOLDER), con, sql)
    assert not problem


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meteorium.llm import exact_dedup, fuse

from .helpers import FOLDER, rows


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000, 70_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    made = fuse.build(np.concatenate([keys, keys[:1]]))
    assert fuse.contains(made, keys).all()
    assert fuse.contains(made, rng.integers(0, 2**64, 50_000, dtype=np.uint64)).mean() < 0.008
    assert len(made[3]) < 1.5 * n + 64


def brute(table):
    groups = defaultdict(set)
    for i, text in table:
        if i is not None:
            groups[text or ""].add(i)
    return {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def texts():
    rng = random.Random(2)
    pool = [None, "", " ", "a", "A", "é" * 9, "x" * 100_000] + [f"text {k}" for k in range(30)]
    table = [(i, rng.choice(pool)) for i in range(300)] + [(i, "copied everywhere") for i in range(300, 500)]
    return table + table[:3] + [(None, "a")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda t: F.substring(exact_dedup.sha256_hex(t), 1, 1)], ids=["sha256", "colliding"])
def test_groups_match_brute_force(spark, digest):
    table = spark.createDataFrame(texts(), "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("digest", F.lit("x"))
    got = exact_dedup.deduplicate(table, digest=digest)
    assert set(rows(got.select("id", "keep_id", "group_size", "kept"))) == brute(texts())
    assert got.count() == len(brute(texts()))


def test_three_batches_and_all_columns_kept(spark):
    table = spark.createDataFrame(texts(), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = exact_dedup.deduplicate(table, batches=[F.col("id") % 3 == 0, F.col("id") % 3 == 1])
    assert set(rows(got.select("id", "keep_id", "group_size", "kept"))) == brute(texts())
    kept = exact_dedup.kept_documents(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, _, k in brute(texts()) if k}


def test_empty_table(spark):
    assert exact_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda t: F.substring(exact_dedup.sha256_hex(t), 1, 1)], ids=["sha256", "colliding"])
def test_every_row_counts(spark, digest, monkeypatch):
    monkeypatch.setattr(exact_dedup, "STEP", 3)
    table = texts() + [(7, "copied everywhere"), (7, "alone"), (None, "nobody's"), (None, "nobody's"), (None, None)] + [(900, "often")] * 8
    got = exact_dedup.deduplicate(spark.createDataFrame(table, "doc_id long, text string"), digest=digest, every_row=True)
    groups = defaultdict(list)
    for i, text in table:
        groups[text or ""].append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(i, best[t or ""], len(groups[t or ""]), None if i is None or best[t or ""] is None else i == best[t or ""]) for i, t in table]
    assert sorted(map(repr, rows(got.select("id", "keep_id", "group_size", "kept")))) == sorted(map(repr, want))


def test_one_row_of_each_text_stays(spark):
    table = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (2, "b"), (1, "c"), (None, "a"), (None, "d"), (None, "d"), (None, "e"), (3, None), (4, "")]
    kept = exact_dedup.kept_documents(spark.createDataFrame(table, "doc_id long, text string"))
    assert sorted(rows(kept), key=repr) == sorted([(2, "a"), (2, "b"), (1, "c"), (None, "d"), (None, "e"), (4, "")], key=repr)


def test_near_copies_and_passages_by_row(spark):
    base = [f"w{k}" for k in range(60)]
    near, other, held = " ".join(base[:-1] + ["x"]), " ".join(f"v{k}" for k in range(40)), " ".join(f"u{k}" for k in range(40))
    table = spark.createDataFrame([(1, " ".join(base)), (2, near), (2, other), (None, "one two three"), (None, held + " y")], "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, table, FOLDER)
    assert sorted(rows(got), key=repr) == sorted([(1, " ".join(base)), (2, other), (None, "one two three"), (None, held + " y")], key=repr)
    passage = " ".join(spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"].split()[:12])
    table = spark.createDataFrame([(2, passage), (2, other), (None, "x " + passage), (None, held)], "doc_id long, text string")
    assert sorted(rows(corpus_pipeline.benchmark_passages(spark, table, FOLDER)), key=repr) == sorted([(2, other), (None, held)], key=repr)

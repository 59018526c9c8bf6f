import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meteorium import session
from meteorium.llm import prefix_tree_join as join
from meteorium.llm.components import components

from .helpers import LOWER, rows


def shingles(text, k):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(table, k, percent):
    sets = [(i, shingles(t, k)) for i, t in table if i is not None]
    lead = {i: i for i, _ in sets}
    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                lead[y] = x
    return sorted({(i, len(s), find(i)) for i, s in sets})


def corpus(rng, hot=40):
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(60))
    table, passage = [], " ".join(word() for _ in range(30))
    for _ in range(25):  # groups of copies with a few words changed, in chains
        base = [word() for _ in range(rng.choice([3, 6, 12, 20, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 4])):
            table.append(" ".join(base) + rng.choice(["", " ", "\n"]))
            base = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                base[rng.randrange(len(base))] = word()
    base = [word() for _ in range(120)]
    for _ in range(hot):  # one large group of near copies
        near = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            near[rng.randrange(len(near))] = word()
        table.append(" ".join(near))
    table += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(15)] + [None, "", " \t", "one", "ONE", "one two", "one two three", "é é é é é", "é É é é"]
    rng.shuffle(table)
    return list(enumerate(table))


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80)])
def test_components_match_brute_force(spark, seed, k, percent):
    table = corpus(random.Random(seed))
    table = table + table[:4] + [(None, "one two")]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("key", F.lit(2)).repartition(4)
    got = sorted(rows(join.near_components(df, words=k, percent=percent).select("id", "n_shingles", "component_id")))
    assert got == brute(table, k, percent)
    kept = join.one_of_each(df, words=k, percent=percent)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, c in got if i == c}


def test_tiles_find_links_that_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(join, "TILE_SETS", 10)
    table = corpus(random.Random(7), hot=80)
    got = sorted(rows(join.near_components(spark.createDataFrame(table, "doc_id long, text string")).select("id", "n_shingles", "component_id")))
    assert got == brute(table, 3, 90)


def test_hub_walks_send_one_side_and_only_a_small_one(spark):
    def plan(n):
        texts = session.materialize(spark.range(n).select("id", F.lit(b"a b").alias("text"), F.lit(b"").alias("digest")))
        pairs = session.materialize(spark.range(n).select((F.col("id") - F.col("id") % 2).alias("hub"), F.col("id").alias("other")))
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            return join._walks(pairs, texts, 5, 80)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    few, many = plan(1000), plan(200_000)
    assert few.count("BroadcastExchange") == 1 and few.count("FileScan") == 2
    assert "BroadcastExchange" not in many and many.count("SortMergeJoin") == 1


def test_linked_sets_share_a_block():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for n in [*range(1, 60), 99, 100, 101, 150, 151, 400, 1000]:
            for _ in range(12):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                gone, fresh = rng.integers(0, max(1, n // 5) + 1), rng.integers(0, max(1, n // 5) + 1)
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, fresh, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = join.block_keys([a, b], percent)
                    assert len(np.intersect1d(x, y)), (percent, n)


def test_tree_walk_matches_brute_force():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0.01, 0.05, 0.2])], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(120)]
    sets += [sets[0], sets[0][:5], base]
    tree = join.Tree(sets)
    for asked in (base, sets[3], sets[0][:5], np.array([1], dtype=np.uint64)):
        want = sorted((i, n) for i, s in enumerate(sets) if 100 * (n := len(np.intersect1d(asked, s))) >= 90 * (len(asked) + len(s) - n))
        assert sorted(tree.linked(asked, 90)) == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (500, 400)]
    got = dict(rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {**{i: 0 for i in range(61)}, **{k: 1000 for k in range(1000, 1100)}, 400: 400, 500: 400}


def test_empty_table(spark):
    assert join.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import random

import numpy as np
from pyspark.sql import functions as F

from meteorium.llm import positional_index as index

from .helpers import rows, words

VOCABULARY = ["the", "of", "und", "ñandú", "x1", "rare"]


def tables():
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(k, some(n)) for k, n in enumerate([1, 3, 9, 10, 11, 14, 25])] + [(7, None), (8, "!?"), (None, "only here rare und rare und rare und x1 x1 of"), (3, some(12))]
    docs = [(k, some(rng.randrange(0, 60))) for k in range(60)] + [(60, None), (61, ""), (62, "THE, of; " + items[6][1].upper().replace("Ñ", "ñ").replace("Ú", "ú")),
                                                                   (63, items[6][1] + " " + items[6][1]), (64, items[9][1]), (64, items[9][1]), (None, items[5][1])]
    return docs, items


def brute(docs, items, width=10):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            for k in range(max(1, len(v) - width + 1) if v else 0):
                window = v[k:k + width]
                for at in range(len(w) - len(window) + 1):
                    if w[at:at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(str(f) for f in found if f is not None))))
    return out


def key(r):
    return (r[0] is None, r)


def test_hits_match_brute_force(spark, tmp_path):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("chunk", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    made = index.build_index(d, str(tmp_path / "i"), chunk_words=200)
    assert made.select("chunk").distinct().count() > 3
    want = sorted(brute(docs, items), key=str)
    for block in (1 << 20, 60):  # in one block, and in several
        got = index.contamination(made, index.search(made, b, block_bytes=block))
        assert sorted(((i, n, h, tuple(x)) for i, n, h, x in rows(got)), key=str) == want
    clean = {r["doc_id"] for r in index.clean_documents(d.filter("doc_id IS NOT NULL"), b).collect()}
    assert clean == {i for i, _, h, _ in want if not h and i is not None}


def test_proximity(spark, tmp_path):
    docs = [(1, "a b c d"), (2, "a b x c d"), (3, "a x x x b c d"), (4, "b a c d")]
    made = index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    hit = lambda slop: {i for i, _, h, _ in rows(index.contamination(made, index.search(made, items, slop=slop))) if h}
    assert hit(0) == {1} and hit(1) == {1, 2, 4} and hit(3) == {1, 2, 3, 4}


def test_places_from_the_rarest_term():
    lists = [np.array([0, 5, 9, 20]), np.array([6, 21]), np.array([2, 7, 22, 30])]
    low, stop = index._places(lists, 0)
    assert low.tolist() == [5, 20] and stop.tolist() == [8, 23]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one, item = spark.createDataFrame([(1, "a b")], docs.schema), spark.createDataFrame([(1, "a b")], items.schema)
    assert index.decontaminate(docs, item).count() == 0
    assert rows(index.decontaminate(one, items).select("id", "n_words", "n_hit")) == [(1, 2, 0)]


def test_items_without_id_or_with_one_id_lie_in_many_blocks(spark, tmp_path, monkeypatch):
    words = [" ".join(f"t{k}x{j}" for j in range(12)) for k in range(200)]
    items = [(None, w) for w in words[:100]] + [(5, w) for w in words[100:]] + [(5, words[100])] * 50
    docs = [(k, f"before {words[k]} after") for k in range(0, 200, 7)] + [(900, "nothing of this")]
    made = index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    sizes, real = [], index.windows_of
    monkeypatch.setattr(index, "windows_of", lambda rows, width: sizes.append(sum(len(t) for _, t in rows)) or real(rows, width))
    found = index.search(made, spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000)
    hit = {i for i, _, h, _ in rows(index.contamination(made, found)) if h}
    assert hit == {i for i, _ in docs if i < 900}
    assert len(sizes) > 5 and max(sizes) < 5000

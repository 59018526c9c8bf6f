import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from meteorium.llm import packing

from .helpers import rows


def cost(bins, lengths, overhead):
    return sum(min(c for c in lengths if c >= sum(b)) + overhead for b in bins)


def best(sizes, lengths, overhead):
    """Least cost over all ways to put the pieces into bins."""
    least = [float("inf")]

    def go(k, bins):
        if k == len(sizes):
            least[0] = min(least[0], cost(bins, lengths, overhead))
            return
        for b in bins:
            if sum(b) + sizes[k] <= lengths[-1]:
                b.append(sizes[k])
                go(k + 1, bins)
                b.pop()
        bins.append([sizes[k]])
        go(k + 1, bins)
        bins.pop()
    go(0, [])
    return least[0]


def test_close_to_the_optimum():
    rng, lengths, spent, least = random.Random(1), (8, 16, 32), 0, 0
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 33) for _ in range(7)), reverse=True)
        bins, length = packing.pack(sizes, lengths, 2)
        held = defaultdict(list)
        for size, b in zip(sizes, bins):
            held[b].append(size)
        assert all(sum(h) <= length[b] and length[b] == min(c for c in lengths if c >= sum(h)) for b, h in held.items())
        spent += sum(length) + 2 * len(length)
        least += best(sizes, lengths, 2)
    assert spent <= 1.05 * least


def test_small_lengths_are_opened_where_they_are_cheaper():
    assert packing.pack([5], (8, 32), 0) == ([0], [8])
    assert packing.pack([32, 3, 3, 2], (8, 32), 0) == ([0, 1, 1, 1], [32, 8])


def test_every_word_stands_once(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"é{i}w{k}" for k in range(rng.choice([1, 5, 40, 130, 700])))) for i in range(120)] + [(200, None), (201, ""), (202, " \n"), (203, "  a  b "), (203, "  a  b ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bin", F.lit("clash"))
    lengths = (32, 64, 128)
    plan = packing.packed(packing.pieces(df, most=128), lengths, group=60)
    got = [r.asDict() for r in plan.collect()]
    text = defaultdict(list)
    for i, t in docs:
        text[i].append(t)
    for i, group in itertools.groupby(sorted(got, key=lambda r: (r["id"], r["piece"])), key=lambda r: r["id"]):
        group = list(group)
        cut = [text[i][0][r["char_start"]:r["char_end"]] for r in group]
        assert all(len(c.split()) == r["tokens"] for c, r in zip(cut, group))
        assert "".join(cut) == text[i][0] * (1 if len(text[i]) == 1 else 2)
    assert {r["id"] for r in got} == {i for i, t in docs if (t or "").split()}
    bins = defaultdict(list)
    for r in got:
        bins[r["group_no"], r["bin"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["position"])
        fill = sum(r["tokens"] for r in held)
        assert all(r["filled"] == fill and r["length"] == min(c for c in lengths if c >= fill) for r in held)
        assert [r["token_start"] for r in held] == [sum(x["tokens"] for x in held[:k]) for k in range(len(held))]
    whole = packing.sequences(plan.filter("id != 203"), df.filter("doc_id != 203"))
    assert all(len(r["text"].split()) == r["filled"] for r in whole.join(plan.filter("id = 203").select("group_no", "bin"), ["group_no", "bin"], "left_anti").collect())


def test_waste_is_small_on_documents(spark):
    plan = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    filled, length = rows(plan.select("group_no", "bin", "length", "filled").distinct().agg(F.sum("filled"), F.sum("length")))[0]
    assert filled / length > 0.97


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_id_or_with_one_id_spread_over_groups(spark):
    docs = [(None, f"w{k} x y")  for k in range(300)] + [(7, f"v{k} x") for k in range(300)]
    plan = packing.packed(packing.pieces(spark.createDataFrame(docs, "doc_id long, text string"), most=16), (8, 16), group=50)
    sizes = [r["count"] for r in plan.groupBy("group_no").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 90

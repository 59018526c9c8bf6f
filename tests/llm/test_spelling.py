import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meteorium.llm import spelling

from .helpers import LOWER, rows

DOCS = "doc_id long, text string"


def counted(table):
    n = Counter()
    for i, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def brute(n):
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for p in range(len(w)):
            holes[w[:p] + "?" + w[p + 1:]].add(w)
            shorter = w[:p] + w[p + 1:]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def typed(n_words=500, seed=1):
    """Words with slips of one letter or two, over few letters, so that many lie close together."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeinÀé×") for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(60)]
    out = set(base)
    while len(out) < n_words:
        w = rng.choice(sorted(out)[:200])
        p, c = rng.randrange(len(w)), rng.choice("abeinéÀ")
        out.add(rng.choice([w[:p] + w[p + 1:], w[:p] + c + w[p:], w[:p] + c + w[p + 1:]]))
    return {w: int(2 * 10 ** rng.uniform(0, 4)) for w in sorted(out) if len(w) >= 7} | {"x" * 5000: 2, "x" * 5001: 40, "y" + "x" * 5000: 7}


@pytest.mark.parametrize("sizes", [{}, {"depth": 4}, {"depth": 20}, {"depth": 1, "cut_at": 300}])
def test_variants_match_brute_force(spark, sizes):
    n = typed()
    got = rows(spelling.variants(spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(5), **sizes))
    assert len(got) == len(n) and set(got) == brute(n)


def test_words_of_texts_match_brute_force(spark):
    rng = random.Random(5)
    names = ["Wörterbuch", "WÖRTERBUCH", "wörterbuch", "wörterbuchs", "wortebuch", "kurz", "sieben7sieben", "Straßenbahn", "straßenbahnen", "ÿÿÿÿÿÿÿ×÷", "don't-overstate"]
    table = [(k, " ".join(rng.choices(names, k=rng.randrange(30)))) for k in range(400)] + [(None, "Wörterbuch " * 3), (7, None), (7, ""), (8, "a" * 100_000), (8, "a" * 100_000)]
    df = spark.createDataFrame(table, DOCS).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).repartition(4)
    assert dict(rows(spelling.word_counts(df))) == counted(table)
    assert set(rows(spelling.spelling_variants(df))) == brute(counted(table))


def test_chains_end_at_the_last_form(spark):
    words = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm"]
    n = {w: 2 * 10**k for k, w in enumerate(words)}
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(sorted(n.items()), "word string, n long")).collect()}
    assert got == {w: words[-1] for w in words}


def test_ties_go_to_the_first_word_in_code_points(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 50, "aaaaaaé": 50, "aaaaaaaa": 50, "aaaaaa×": 50}
    assert set(rows(spelling.variants(spark.createDataFrame(sorted(n.items()), "word string, n long")))) == brute(n)


@pytest.mark.parametrize("u,v", [("abc", "abc"), ("", ""), ("", "a"), ("ab", "ba"), ("abc", "abd"), ("abc", "xabc"), ("abc", "abcx"), ("abc", "abxx"), ("abc", "acb")])
def test_one_edit(u, v):
    edits = {u[:p] + u[p + 1:] for p in range(len(u))} | {u[:p] + c + u[p + d:] for p in range(len(u) + 1) for c in "abcdx" for d in (0, 1)}
    assert spelling.one_edit(u.encode(), v.encode()) == (v in edits - {u}) == spelling.one_edit(v.encode(), u.encode())


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0

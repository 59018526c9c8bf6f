import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meteorium.llm import collocations

from .helpers import LOWER, rows

DOCS = "doc_id long, text string, lang string"


def brute(table, least, top):
    counts, total = {}, Counter()
    for _, text, lang in table:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        cand = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * cand[q] >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in cand if len(q) > len(p)):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top])}
    return out


def texts(n=300):
    rng = random.Random(4)
    vocabulary = ["of", "the", "OF", "New", "york", "city", "a", "don't", "é", "ü x", "\x01", "\x1c"]
    def text():
        return "".join(rng.choice(vocabulary + ["in New York City"]) + rng.choice([" "] * 8 + ["\t", "  ", ". ", "\n", ",", "\r\n"]) for _ in range(rng.randrange(40)))
    table = [(k, text(), rng.choice(["en", "fr", None])) for k in range(n)]
    return table + [(n, None, "en"), (n, "", "de"), (None, " \t ", None), (1, "hot pair " * 3000, "en"), (2, "x." * 50, "und"), (2, "x." * 50, "und")]


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 400, "room": 150, "held": 20}])
def test_collocations_match_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(collocations, "STEP", 37)
    table = texts()
    df = spark.createDataFrame(table, DOCS).withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1)).repartition(5)
    got = rows(collocations.collocations(df, least=6, top=40, **sizes))
    assert len(got) == len(set(got)) and set(got) == brute(table, 6, 40)


def test_first_pass_keeps_every_frequent_word_and_pair(spark, monkeypatch):
    monkeypatch.setattr(collocations, "STEP", 50)
    monkeypatch.setattr(collocations, "BUCKETS_HELD", 60)
    table = texts()
    held = collocations.frequent_buckets(collocations._texts(spark.createDataFrame(table, DOCS).repartition(3), "text", "lang"), 6)
    want = (set(), set())
    for lang in ("en", "fr", "und"):
        words, pairs = Counter(), Counter()
        for _, text, at in table:
            if (at or "und") == lang:
                found = collocations.words_of((text or "").encode())
                words.update(w for w in found if w)
                pairs.update(p for p in zip(found, found[1:]) if all(p))
        for kind, counts in enumerate((words, pairs)):
            for key, n in counts.items():
                hashes = np.array([zlib.crc32(w) for w in (key if kind else (key, key))], dtype=np.uint64)
                bucket = int(collocations.buckets_of(hashes, lang)[kind][0])
                if n >= 6:
                    want[kind].add(bucket)
    for kind in (0, 1):
        assert set(np.flatnonzero(np.unpackbits(held[kind], bitorder="little")).tolist()) == want[kind] and want[kind]


def test_few_buckets_only_cut_less(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKETS", 4)
    monkeypatch.setattr(collocations, "PART", 3)
    table = texts()
    assert set(rows(collocations.collocations(spark.createDataFrame(table, DOCS), least=6, top=40))) == brute(table, 6, 40)


def test_counts_of_prefixes_that_fences_cut(spark):
    table = texts()
    df = spark.createDataFrame(table, DOCS).repartition(4)
    whole = set(rows(collocations.phrase_counts(df, 3)))
    cut = rows(collocations.phrase_counts(df, 3, range_bytes=150, room=40))
    assert set(cut) == whole and len(cut) == len(whole)
    assert len(collocations._lang_fences(collocations._texts(df, "text", "lang"), 150)["en"]) > 20


def test_trie_bursts_and_gives_back_every_window():
    rng = random.Random(1)
    words = [b"w%d" % (int(rng.paretovariate(0.7)) % 60) for _ in range(6000)] + [b""] * 3
    trie = collocations.HatTrie(burst=8)
    for start in range(0, len(words), 500):
        trie.add(words[start:start + 503])
    nodes = [box for box in trie.top.values() if box.__class__ is collocations._Node]
    assert any(inner.__class__ is collocations._Node for box in nodes for inner in box.values())
    want = Counter(b"".join(w + b" " for w in words[i:i + 4] if w) for i in range(len(words) - 3))
    assert trie.held == len(want)
    assert sum(trie.sizes.values()) == trie.held and len(trie.largest(trie.held)) == len(trie.top)
    half = trie.take(trie.largest(trie.held // 2))
    assert trie.held <= len(want) // 2
    rest = trie.take(list(trie.top))
    for run in (half, rest, collocations.joined([half, rest, half.part(2, 9)])):
        phrases = [run.phrase(k) for k in range(len(run.counts))]
        assert phrases == sorted(set(phrases))
        assert [run.below(p) for p in phrases] == list(range(len(phrases)))
        assert all(run.below(p + b"zz ") == k + 1 for k, p in enumerate(phrases) if p.count(b" ") < 4 and (k + 1 == len(phrases) or not phrases[k + 1].startswith(p)))
    found = {run.phrase(k): int(n) for run in (half, rest) for k, n in enumerate(run.counts)}
    assert found == want and trie.held == 0


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**18
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, words int, f long")
    assert rows(collocations.scored(counts).select("phrase", "score")) == [("a b", 2_000_000 * (big - 7) // (2 * big - 1))]
    phrases = spark.createDataFrame([("en", "a b", 2, 10**17), ("en", "a b c", 3, 8 * 10**16), ("en", "b c", 2, 10**17 + 1)], "lang string, phrase string, words int, a long")
    assert sorted(r["phrase"] for r in collocations.not_contained(phrases).collect()) == ["a b c", "b c"]


def test_ranks_cut_in_parts_are_ranks_of_all(spark):
    rng = random.Random(2)
    table = [("en", f"p{k}", rng.randrange(30), rng.randrange(5)) for k in range(900)]
    got = rows(collocations.top_by_lang(spark.createDataFrame(table, "lang string, phrase string, score long, a long"), 7).select("rank", "phrase"))
    assert sorted(got) == [(i + 1, t[1]) for i, t in enumerate(sorted(table, key=lambda t: (-t[2], -t[3], t[1]))[:7])]


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0

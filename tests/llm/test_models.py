import random

import numpy as np
from pyspark.sql import functions as F

from meteorium.llm import language, q_models, toxicity
from meteorium.llm.words import WordRows, grams

from .helpers import FOLDER, rows

PARTS = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "eit", "ver", "über"], "cc": ["ción", "ando", "los", "ñe", "qui"]}


def written(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n)).capitalize()


def test_grams_of_words():
    made = {n: (owner.tolist(), at.tolist(), h.tolist()) for n, owner, at, h in grams([b"ab", "é".encode()], range(1, 5))}
    assert [len(made[n][0]) for n in (1, 2, 3, 4)] == [7, 5, 3, 1]
    assert made[3][0] == [0, 0, 1] and made[4][1] == [0]
    assert next(iter(grams([b"zab"], range(3, 4))))[3][2] == made[3][2][1]  # "ab>" wherever it stands


def test_word_rows_forget_and_learn():
    seen = []
    def unseen(words):
        seen.append(list(words))
        return np.array([[float(len(w))] for w in words])
    held = WordRows({b"known": 0}, np.array([[9.0]]), unseen, room=2)
    for _ in range(3):
        numbers = held.numbers([[b"known", b"a", b"bb"], [b"ccc"], []])
        assert [held.matrix[n].ravel().tolist() for n in numbers] == [[9.0, 1.0, 2.0], [3.0], []]
    assert seen == [[b"a", b"bb", b"ccc"]] * 3


def test_languages_of_unseen_words(spark):
    rng = random.Random(1)
    train = [(i, written(rng, lang, 30), lang) for i, lang in enumerate(list(PARTS) * 40)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    new = [(i, written(rng, lang, n), lang) for i, (lang, n) in enumerate([(lang, n) for lang in PARTS for n in (4, 10, 500)] * 5)]
    odd = [(100, None, "x"), (101, "", "x"), (102, "12 !? 34", "x"), (103, "漢字", "x")]
    df = spark.createDataFrame(new + odd, "doc_id long, text string, score string").withColumn("lang_pred", F.lit("clash"))
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in new) >= 0.95 * len(new)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103]["lang_pred"] in PARTS and all(0 <= r["score"] <= 1 for r in got.values())


def test_known_words_score_as_by_hand(spark):
    train = [(1, "ka ka lo", "aa"), (2, "lo lo lo ver", "bb"), (3, "x", None), (4, None, "aa")]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = rows(language.predict(spark.createDataFrame([(9, "KA, lo!")], "doc_id long, text string"), model, keep=[F.col("doc_id")]))
    share = lambda n, of: np.log((n + 0.1) / (of + 0.3))  # noqa: E731  three words are known
    aa, bb = share(2, 3) + share(1, 3), share(0, 4) + share(3, 4)
    assert got[0][1] == ("aa" if aa > bb else "bb") and abs(got[0][2] - 1 / (1 + np.exp(-abs(aa - bb)))) < 1e-5


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert rows(language.predict(docs, language.fit(docs), keep=[F.col("doc_id")])) == [(1, "und", 0.0)]
    assert language.predict(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def test_a_bound_takes_words_not_labels_of_words(spark):
    text = lambda word, n: " ".join([word] * n)
    train = [(1, text("aa", 9), "x"), (2, text("aa", 3), "y"), (3, text("bbb", 5), "y"), (4, text("ccc", 2), "x")]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model, whole = language.fit(df, max_words=1), language.fit(df, max_words=None, max_grams=None)
    assert list(model.known) == [b"aa"] and set(whole.known) == {b"aa", b"bbb", b"ccc"}
    logs = np.log([(9 + 0.1) / (11 + 0.1), (3 + 0.1) / (8 + 0.1)])  # out of all words of each language
    assert np.allclose(model.words[0, :2], logs - logs.mean())


def test_backoff_matches_brute_force(spark):
    """Unseen words letter by letter: the longest known n-gram that begins at a letter speaks."""
    rng = random.Random(6)
    train = [(i, written(rng, lang, 25), lang) for i, lang in enumerate(list(PARTS) * 4)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), max_words=None, max_grams=None)
    counts = {}
    for _, text, lang in train:
        for word in language.lowered(text, language.LETTER_BYTES):
            spelled = f"<{word.decode('utf-8', 'replace')}>"
            for n in language.ORDERS:
                for p in range(len(spelled) - n + 1):
                    counts.setdefault(n, {}).setdefault(spelled[p:p + n], dict.fromkeys(sorted(PARTS), 0))[lang] += 1
    said = {}
    for n, held in counts.items():
        whole = {lang: sum(c[lang] for c in held.values()) for lang in PARTS}
        for gram, c in held.items():
            logs = np.array([np.log((c[lang] + 0.1) / (whole[lang] + 0.1 * len(held))) for lang in sorted(PARTS)])
            said[gram] = logs - logs.mean()
    for word in ("kalomix", "schungx", "qqq", "ciónandoz", "ü", "xyzlos"):
        spelled, votes, telling = f"<{word}>", [], False
        for p in range(len(spelled)):
            for n in reversed(language.ORDERS):
                if spelled[p:p + n] in said and len(spelled[p:p + n]) == n:
                    votes.append(said[spelled[p:p + n]])
                    telling |= n >= 3
                    break
        got = model.unseen([word.encode()])[0]
        assert np.allclose(got[:3], np.mean(votes, axis=0) if votes else np.zeros(3), atol=1e-5) and got[3] == float(telling)


def test_language_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = q_models.op6_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def toxic_texts(rng, n, first=0):
    bad = ["scoundrel", "numbskull", "blockhead"]
    out = []
    for i in range(first, first + n):
        text = [("".join(rng.choice(["an", "the", "ing", "ed", "or", "st"]) for _ in range(rng.choice([1, 2, 3])))) for _ in range(rng.choice([20, 100, 400]))]
        if i % 5 == 0:
            text[rng.randrange(len(text))] = rng.choice(bad)
        out.append((i, " ".join(text), int(i % 5 == 0)))
    return out


def test_toxic_words_and_their_misspellings(spark):
    rng = random.Random(3)
    train = toxic_texts(rng, 400)
    df = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    test = toxic_texts(rng, 200, 1000) + [(5000, "anst scoundrell the", 1), (5001, "the numbskul ing", 1), (5002, None, 0), (5003, "", 0), (5004, "!!", 0)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([t[:2] for t in test], "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(t) for i, _, t in test]) > 0.97
    assert got[5000] > 0.3 and got[5001] > 0.3


def test_passages_match_brute_force():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.25, (1.5, -0.5, -0.3, 0.1))
    for n in range(0, 14):
        words = [f"w{k}x{k * k}".encode() for k in range(n)]
        scores = model.unseen(words) if n else np.zeros(0)
        for k, word in enumerate(words):  # a word is the mean of its subwords
            buckets, _ = toxicity.subwords([word])
            assert np.isclose(scores[k], np.mean(model.weights[buckets]))
        half = toxicity.HALF
        passages = [scores[k:k + 2 * half] for k in range(0, max(1, n - half), half)] if n else []
        worst = max((p.mean() for p in passages), default=0.0) + 0.25
        want = (worst, (scores.mean() if n else 0.0) + 0.25, np.log(len(passages)) if n else 0.0, 1.0)
        got = model.features(scores)
        assert np.allclose(got, want)
        assert abs(model.probability(got) - 1 / (1 + np.exp(-(1.5 * want[0] - 0.5 * want[1] - 0.3 * want[2] + 0.1)))) < 1e-12


def test_gradient_steps_lower_the_loss_of_averaged_bags():
    texts = [b"alpha beta gamma delta".split(), b"alpha beta vile delta beta gamma".split(), b"gamma".split(), []]
    labels = np.array([0, 1, 0, 0])
    model = toxicity._embed(texts, labels, rounds=80, warm=10)
    worst = [model.features(model.unseen(t) if t else np.zeros(0))[0] for t in texts]
    assert worst[1] > 1 and max(worst[0], worst[2], worst[3]) < 0


def test_long_clean_texts_stay_clean(spark):
    rng = random.Random(9)
    train = toxic_texts(rng, 1200)
    df = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    clean = [t for _, t, k in toxic_texts(rng, 300, 5000) if not k]
    long = [(n * 10 + k, " ".join(rng.choices(clean, k=n))) for n in (1, 10, 50, 200, 800) for k in range(4)]
    got = rows(toxicity.score(spark.createDataFrame(long, "doc_id long, text string"), model, keep=[F.col("doc_id")]))
    assert max(s for _, s in got) < 0.3


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for label, want in ((0, 0.0), (1, 1.0), (None, 0.0), (7, 0.0)):
        labels = spark.createDataFrame([(1, label), (None, 1)], "doc_id long, toxic int")
        assert all(abs(s - want) < 1e-9 for _, s in rows(toxicity.score(docs, toxicity.fit(docs, labels), keep=[F.col("doc_id")])))
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))).count() == 0


def test_toxicity_query_has_a_row_per_document(spark):
    got = q_models.op9_toxicity(spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.filter("predicted != cast(score >= 0.3 as int)").count() == 0 and got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_language_counts_travel_in_arrow(spark, monkeypatch):
    """The driver gets the counts as an Arrow table, not as a list of rows, and learns the same from them."""
    seen, build = [], language.Model.__init__
    monkeypatch.setattr(language.Model, "__init__", lambda self, counts, *args, **named: (seen.append((counts, args, named)), build(self, counts, *args, **named))[0])
    table = spark.createDataFrame([(1, "the cat the dog", "en"), (2, "der hund der žar", "de"), (3, "the žar", "en"), (4, None, "en"), (5, "ohne", None)], "doc_id long, text string, lang string")
    model = language.fit(table)
    counts, args, named = seen[0]
    assert not isinstance(counts, list)
    assert list(counts) == [("de", b"der", 2), ("de", b"hund", 1), ("de", "žar".encode(), 1), ("en", b"cat", 1), ("en", b"dog", 1), ("en", b"the", 3), ("en", "žar".encode(), 1)]
    plain = language.Model(list(counts), *args, **named)
    assert model.known == plain.known and np.array_equal(model.words, plain.words)
    assert all(np.array_equal(a, b) for n in plain.grams for a, b in zip(model.grams[n], plain.grams[n]))

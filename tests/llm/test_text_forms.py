"""License scan and preference formatting."""

from pyspark.sql import functions as F

from meteorium.llm import licenses, preferences

from .helpers import rows


def test_license_parts(spark):
    body = licenses.TEMPLATES[1][1]
    docs = [(1, "prose of five words here\nReleased under the MIT License.\nmore prose"), (2, "RELEASED under the mit-license"), (3, None), (4, ""), (5, "word"),
            (6, "intro\n\n" + body.replace(". ", ".\n") + "\n \nend"), (7, "Released under the license"), (7, "Released under the license"), (8, "licensedK")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("license", F.lit("x"))
    got = {tuple(r) for r in licenses.scan(df).select("id", "kind", "license").collect()}
    assert got == {(1, "line", "mit"), (2, "line", "mit"), (6, "block", "apache-2.0")}
    assert [r["dice"] for r in licenses.scan(df).filter("id = 1").collect()] == [1.0]


def test_license_size_bounds_lose_nothing(spark):
    rng, words = __import__("random").Random(2), licenses.TEMPLATES[10][1].split()
    lines = []
    for i in range(300):
        w = [x for x in words if rng.random() > rng.choice([0.02, 0.1, 0.3])] + ["extra"] * rng.randrange(0, 20)
        lines.append((i, " ".join(w)))
    def grams(text):
        w = __import__("re").findall("[a-z0-9]+", text.lower())
        return set(zip(w, w[1:]))
    want = {(i, k) for i, line in lines for k, (_, t) in enumerate(licenses.TEMPLATES) for a, b in [(grams(line), grams(t))] if 200 * len(a & b) >= 80 * (len(a) + len(b))}
    got = {(r["id"], r["template"]) for r in licenses.scan(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == want and 20 < len(want) < 300
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute(a, b):
    n = 0
    while a is not None and b is not None and n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    def render(turns):
        text, spans = "", []
        for role, body in turns:
            text += f"<|im_start|>{role or ''}\n"
            start = len(text)
            text += f"{body or ''}<|im_end|>"
            spans += [f"{start}:{len(text)}"] * (role == "assistant")
            text += "\n"
        return text, ",".join(spans)
    one = [render(x[n:]) if x is not None else (None, None) for x in (a, b)]
    return n, render((a or [])[:n])[0], *one[0], *one[1]


def test_preferences_match_brute_force(spark):
    u, s, x, y = ("user", "hé𝔘llo"), ("system", "s"), ("assistant", "yes\n"), ("assistant", "no")
    talks = {0: [s, u, x], 1: [s, u, y], 2: [u, x], 3: [u, x], 4: [u], 5: [u, x, u, y], 6: [u, (None, None)], 7: [u], 8: [(None, None)], 9: [(None, None), (None, "t")], 10: [u, x], 13: [y]}
    table = [(c, t, *turn) for c, turns in talks.items() for t, turn in enumerate(turns)][::-1] + [(None, 0, "user", "lost")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("pair_id", F.lit(1))
    got = {r["pair_id"]: tuple(r)[3:] for r in preferences.preference_pairs(df).collect()}
    assert got == {p: brute(talks.get(2 * p), talks.get(2 * p + 1)) for p in {c // 2 for c in talks}}
    pairs = spark.createDataFrame([("z", 13, 10)], "pair_id string, chosen_id long, rejected_id long")
    assert tuple(preferences.preference_pairs(df, pairs).first())[3:] == brute(talks[13], talks[10])
    assert rows(preferences.preference_pairs(df.limit(0))) == []


def test_pairs_of_large_and_negative_ids(spark):
    ids = [2**60, 2**60 + 1, 2**60 + 2, 2**60 + 3, -4, -3, -2**62, -2**62 + 1, 0, 1]
    turns = spark.createDataFrame([(i, 0, "user", "same") for i in ids] + [(i, 1, "assistant", str(i)) for i in ids], "conv_id long, turn int, role string, text string")
    got = {(r.chosen_id, r.rejected_id, r.n_common) for r in preferences.preference_pairs(turns).collect()}
    assert got == {(i, i + 1, 1) for i in ids if i % 2 == 0}

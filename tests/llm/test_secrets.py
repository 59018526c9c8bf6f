import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from meteorium.llm import q_secrets, secrets
from meteorium.llm.spans import matches, running

FOLDER = "/root/testdata/sf0.001"
KEY = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
FORMS = [("assign", re.compile(KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, form, group, least) in enumerate(FORMS) for m in form.finditer(text or "") if len(m.group(group)) >= least]
    return [(FORMS[k][0], a, z) for a, k, z in sorted(found)]


def listed(spans):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


CASES = [None, "", "token = token:abcdefghij", "TOKEN='abcdefgh' api_key=\"x\" apikey: ABCDEFGH.=", "é𝔘 password=12345678 é", "AKIAAKIA AKIA" + "B" * 12 + " AKIAB",
         "f" * 31 + "x" + "0" * 32, "secret:" + "a" * 33, "passwd=" + "0123456789abcdef" * 3, "token=secret=abcdefgh12", "KKey ſecret=abcdefgh api_Key=abcdefgh"]


def test_known_forms_match_brute_force(spark):
    table = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("base", F.lit(1))
    got = {r["id"]: [(secrets.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]] for r in secrets.scan(table).collect()}
    assert got == {i: brute(t) for i, t in enumerate(CASES)}


def test_query_on_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = q_secrets.op7_secrets(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        base = brute(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == name for k, _, _ in base) for name in ("assign", "access", "hex"))
        assert set(map(tuple, (s.split(":") for s in listed(base).split(",") if s))) <= set(map(tuple, (s.split(":") for s in r["spans"].split(",") if s)))


def test_counts_by_kind_in_any_order(spark, tmp_path):
    kinds = {"assign": "token=abcdefgh", "access": "AKIA" + "B" * 12, "hex": "0" * 32}
    texts = [" ".join(kinds[k] for k in order) for order in (["hex"], ["access"], ["hex", "hex", "access"], ["access", "assign", "assign", "assign"], ["assign", "hex", "access", "hex"])]
    spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in q_secrets.op7_secrets(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0, 1), 1: (0, 1, 0), 2: (0, 1, 2), 3: (3, 1, 0), 4: (1, 1, 2), 9: (0, 0, 0)}


def test_battery_tells_random_from_written_strings(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secret = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    written = ["_".join(rng.choice(["user", "name", "value1", "total2", "index", "table"]) for _ in range(8)) for _ in range(300)]
    table = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(secret + written)], "doc_id long, text string")
    hit = {r["id"] for r in secrets.scan(table).filter("size(spans) > size(base)").collect()}
    assert len(hit & set(range(60))) >= 50 and len(hit - set(range(60))) <= 8


BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_values_behind_names_paths_and_prefixes(spark):
    rng = random.Random(11)
    forms = ["DB_PASS={}", "https://a.b/c?sig={}&x=1", "AccountKey={}==;", "AWS_SECRET_ACCESS_KEY={}", "/etc/some_service/credential-files/{}", "live_key-for/deploy_{}", "x {} y"]
    made = [(f, "".join(rng.choice(BASE62) for _ in range(40))) for f in forms for _ in range(30)]
    table = spark.createDataFrame([(i, f.format(v)) for i, (f, v) in enumerate(made)], "doc_id long, text string")
    found = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(table).collect()}
    for k, form in enumerate(forms):
        ids = range(30 * k, 30 * k + 30)
        at = {i: form.index("{}") for i in ids}
        hit = [i for i in ids if any(a <= at[i] and at[i] + 40 <= z for a, z in found[i])]
        assert len(hit) >= 24, form
    spans = [s for v in found.values() for s in v]
    assert all(not (a != b and a[0] <= b[0] and b[1] <= a[1]) for v in found.values() for a in v for b in v) and len(spans) < 1.5 * len(made)


def test_a_lone_secret_needs_no_others(spark):
    rng = random.Random(4)
    for _ in range(200):
        value = "".join(rng.choice(BASE62) for _ in range(40))
        p = spark.range(1).select(secrets.randomness(F.lit(value), F.lit(BASE62)).alias("p")).first()["p"]
        if 0.1 < p < 0.4 and any(c.isdigit() for c in value):
            break
    table = spark.createDataFrame([(1, f"x {value} y"), (2, "x user_name1_user_name1_user_name1_user_name1 y")], "doc_id long, text string")
    assert {r["id"] for r in secrets.scan(table).filter("size(spans) > 0").collect()} == {1}


def test_p_value_against_plain_python(spark):
    value, alphabet = "3f9a0c17be5522d4e8a1", "0123456789abcdef"
    got = spark.range(1).select(secrets.randomness(F.lit(value), F.lit(alphabet)).alias("p")).first()["p"]
    v, n, a = [alphabet.index(c) for c in value], len(value), 16
    chi = (a / n * sum(v.count(k) ** 2 for k in range(a)) - n - (a - 1)) / math.sqrt(2 * (a - 1) * (1 - 1 / n))
    runs = (sum((x < 8) != (y < 8) for x, y in zip(v, v[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    serial = sum((x - 7.5) * (y - 7.5) for x, y in zip(v, v[1:])) / ((a * a - 1) / 12 * math.sqrt(n - 1))
    q = chi ** 2 + runs ** 2 + serial ** 2
    assert got == pytest.approx(math.erfc(math.sqrt(q / 2)) + math.sqrt(2 * q / math.pi) * math.exp(-q / 2), abs=1e-6)


def test_places_in_long_texts(spark):
    text = " ".join(f"é{'x' * (i % 7)} password=abcdefgh{i}" for i in range(1000))
    table = spark.createDataFrame([(text,)], "text string")
    got = table.select(matches(F.col("text"), secrets.ASSIGN, 1).alias("m")).first()["m"]
    assert [(m["start"], m["end"], m["part"]) for m in got] == [(m.start(), m.end(), m.group(1)) for m in FORMS[0][1].finditer(text)]
    numbers = list(range(1, 700))
    assert spark.createDataFrame([(numbers,)], "n array<int>").select(running(F.col("n")).alias("r")).first()["r"] == [sum(numbers[:k]) for k in range(len(numbers))]


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0

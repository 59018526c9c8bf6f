import base64
import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meteorium.llm import runs, warc

from .helpers import rows

PAGES = "page_id long, url string, html string"


def batches(keys, size):
    return [pa.RecordBatch.from_pydict({"k": keys[s:s + size], "n": list(range(s, min(s + size, len(keys))))}) for s in range(0, len(keys), size)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_loser_tree_merges_any_number_of_sources(k):
    rng = random.Random(k)
    sources = [sorted(rng.choices(range(50), k=rng.choice([0, 1, 5, 40]))) for _ in range(k)]
    tree, got = runs.LoserTree(sources), []
    while tree.peek() is not None:
        source, place = tree.pop()
        got.append((sources[source][place], source, place))
    assert [g[0] for g in got] == sorted(x for s in sources for x in s)
    assert got == sorted(got)  # ties by number of the source


@pytest.mark.parametrize("most", [1, 10, 10_000])
def test_blocks_of_runs_merge_in_order(most):
    rng = random.Random(most)
    blocks = [b for _ in range(9) for b in batches(sorted(rng.choices(range(300), k=rng.randrange(1, 120))), 16)]
    blocks.sort(key=lambda b: b["k"][0].as_py())
    got = [k for b in runs.merge(iter(blocks), ["k"], most) for k in b["k"].to_pylist()]
    assert got == sorted(k for b in blocks for k in b["k"].to_pylist())


def test_cut_at_fences():
    keys = [(k,) for k in [1, 1, 2, 5, 5, 9]]
    batch = pa.RecordBatch.from_pydict({"k": [k for k, in keys]})
    assert [(k, b["k"].to_pylist()) for k, b in runs.cut(batch, keys, [(2,), (3,), (9,)])] == [(0, [1, 1]), (1, [2]), (2, [5, 5]), (3, [9])]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages():
    rng = random.Random(3)
    bodies = [None, "", "a", "A", "é✓", "\r\n\r\n", "\r\nx\r\n", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "y\r\n", "long " * 60_000] + [f"<p>{k}</p>" for k in range(20)]
    urls = [None, "", "no scheme", "http://a.example.com/x?q=1#f", "https://B.example.com:8080/é", "http://b.example.org/\r\nWARC-Type: metadata"]
    return [(k * 7 % 401 - 40, rng.choice(urls), rng.choice(bodies)) for k in range(300)] + [(1000 + k, urls[3], "copied") for k in range(150)]


def expected(table):
    first = {}
    for i, _, html in table:
        first[html or ""] = min(first.get(html or "", i), i)
    return {(i, len((h or "").encode()), digest(h), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))) for i, _, h in table}


def test_round_trip_and_order_against_brute_force(spark, tmp_path):
    table = pages()
    df = spark.createDataFrame(table, PAGES).withColumn("url_key", F.lit("x")).withColumn("id", F.lit(0)).repartition(7)
    index = warc.archive_index(df, str(tmp_path / "a"))
    got = rows(index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert len(got) == len(table) and set(got) == expected(table)
    assert index.filter("NOT intact").isEmpty() and warc.unresolved(index).isEmpty()
    urls = {r["page_id"]: r["url"] for r in index.collect()}
    assert all(urls[i] == (u if u is None else u.replace("\r", "%0D").replace("\n", "%0A")) for i, u, _ in table if u != "")


def test_files_hold_records_one_after_another(spark, tmp_path):
    path = warc.write_archives(warc.captures(spark.createDataFrame(pages(), PAGES)), str(tmp_path / "a"), file_records=50)
    found = {r["file"].split("/")[-1]: [] for r in warc.read_archives(spark, path).collect()}
    for r in warc.read_archives(spark, path).collect():
        found[r["file"].split("/")[-1]].append(r)
    assert len(found) >= 9
    for name, of_file in found.items():
        data, end = gzip.decompress((tmp_path / "a" / name).read_bytes()), 0
        for r in sorted(of_file, key=lambda r: r["offset"]):
            assert r["offset"] == end and data[end:end + 8] == b"WARC/1.1"
            head, _, body = data[end:end + r["size"]].partition(b"\r\n\r\n")
            assert f"Content-Length: {len(body)}".encode() in head.split(b"\r\n")
            end += r["size"] + 4
        assert end == len(data)


@pytest.mark.parametrize("fan_in", [2, 3, 128])
def test_histories_are_globally_ordered_in_many_ranges_and_passes(spark, tmp_path, fan_in, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 32)
    table = [(k, f"http://{'abc'[k % 3] if k % 2 else 'hot'}.example.com/{k % 5}", f"{k % 90}") for k in range(4000)]
    path = warc.write_archives(warc.captures(spark.createDataFrame(table, PAGES).repartition(9)), str(tmp_path / "a"), file_records=200)
    found = warc.read_archives(spark, path)
    index = warc.histories(found, fan_in=fan_in, range_rows=300).collect()
    keys = [(r["url_key"], r["captured"], r["record_id"]) for r in sorted(index, key=lambda r: (r["range_no"], r["place"]))]
    assert keys == sorted(keys) and len(keys) == 4000 == len(set(keys))
    counts = [sum(r["range_no"] == k for r in index) for k in {r["range_no"] for r in index}]
    assert len({(r["range_no"], r["place"]) for r in index}) == 4000 and max(counts) < 900


def test_rows_without_id_and_repeated_rows(spark, tmp_path):
    table = [(None, "http://a/", "x"), (None, "http://a/", "x"), (5, "http://b/", "x"), (5, "http://b/", "x"), (5, "http://a/", "x"), (None, None, "only"), (None, None, "only"), (9, "u", None)]
    index = warc.archive_index(spark.createDataFrame(table, PAGES), str(tmp_path / "a")).collect()
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in index)
    assert got == sorted([("None", "revisit", "5"), ("None", "revisit", "5"), ("5", "response", "None"), ("5", "revisit", "5"), ("5", "revisit", "5"),
                          ("None", "response", "None"), ("None", "revisit", "None"), ("9", "response", "None")])
    assert len({r["record_id"] for r in index}) == len(table)


def test_small_payloads_may_stay_responses(spark, tmp_path):
    table = [(k, "http://a/", "tiny" if k % 2 else "rather long payload") for k in range(10)] + [(1, "http://a/", "tiny")]
    index = warc.archive_index(spark.createDataFrame(table, PAGES), str(tmp_path / "a"), least_bytes=10)
    assert sorted(rows(index.groupBy("record_type", "payload_bytes").count())) == [("response", 4, 6), ("response", 19, 1), ("revisit", 19, 4)]
    assert index.select("record_id").distinct().count() == 11


def test_empty_table_and_damage(spark, tmp_path):
    assert warc.archive_index(spark.createDataFrame([], PAGES), str(tmp_path / "none")).count() == 0
    path = warc.write_archives(warc.captures(spark.createDataFrame([(1, "http://a/", "text " * 50)], PAGES)), str(tmp_path / "a"))
    for file in (tmp_path / "a").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        (tmp_path / "changed.txt.gz").write_bytes(gzip.compress(data.replace(b"text text", b"text next", 1)))
        (tmp_path / "short.txt.gz").write_bytes(gzip.compress(data[:-60]))
    assert warc.read_archives(spark, path).select("intact").collect() == [(True,)]
    assert warc.read_archives(spark, str(tmp_path / "changed.txt.gz")).select("intact").collect() == [(False,)]
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, str(tmp_path / "short.txt.gz")).collect()


def test_address_keys(spark):
    df = spark.createDataFrame([("HTTP://User.Example.COM:80/A?b=c#d",), ("no scheme/x",), (None,), ("",), ("https://a.b",), ("http://a.b?x",)], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["com,example,user):80/A?b=c", "no scheme)/x", "", "", "b,a)", "b,a)?x"]

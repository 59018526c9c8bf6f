import datetime as dt
import hashlib

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from meteorium import session
from meteorium.functions import text
from meteorium.operators import change, quality
from meteorium.plans import emissions
from meteorium.sources import readers, sinks

DESCRIPTOR = """
resources:
  - name: daily
    schema:
      fields:
        - {name: location, type: string, title: Station}
        - {name: date, type: date}
        - {name: value, type: number, title: Temperature, unit: degC}
        - {name: source, type: string}
  - name: yearly
    schema: {fields: [{name: year, type: year}, {name: n, type: integer}, {name: at, type: datetime}]}
"""


def test_schema_from_descriptor():
    s = readers.schema_from_descriptor(DESCRIPTOR)
    assert s["yearly"].simpleString() == "struct<year:int,n:int,at:timestamp>"
    assert s["daily"]["value"].metadata == {"title": "Temperature", "unit": "degC"}
    with pytest.raises(ValueError):
        readers.schema_from_descriptor("resources: [{name: x}]")


def test_station_files_and_default_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("location,date,value,source\nA,2000-01-01,1.5,era5t\n")
    (tmp_path / "b.csv").write_text("location,date,value,source\nB,2000-01-02,2.5,\n")
    rows = readers.read_station_files(spark, str(tmp_path), readers.schema_from_descriptor(DESCRIPTOR)["daily"]).orderBy("location").collect()
    assert [(r.location, r.date, r.source, r.file_name) for r in rows] == [("A", dt.date(2000, 1, 1), "era5t", "a.csv"), ("B", dt.date(2000, 1, 2), "era5", "b.csv")]


def test_short_and_reordered_station_files(spark, tmp_path):
    schema = readers.schema_from_descriptor(DESCRIPTOR)["daily"]
    (tmp_path / "a.csv").write_text("location,date,value\nA,2001-02-03,1.5\nA,2001-02-04,1.75\n")
    (tmp_path / "b.csv").write_text("value,location,extra,date,source\n2.5,B,x,2001-02-03,era5t\n")
    (tmp_path / "c.csv").write_text("source,value,date,location\n,3.5,2001-02-03,C\n")
    rows = readers.read_station_files(spark, str(tmp_path), schema).orderBy("location", "date").collect()
    assert [(r.location, str(r.date), r.value, r.source, r.file_name) for r in rows] == [
        ("A", "2001-02-03", 1.5, "era5", "a.csv"), ("A", "2001-02-04", 1.75, "era5", "a.csv"), ("B", "2001-02-03", 2.5, "era5t", "b.csv"), ("C", "2001-02-03", 3.5, "era5", "c.csv")]


def test_malformed_lines_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("location,date,value\nA,2001-02-03,warm\nA,2001-02-04,1.0\n")
    df = readers.read_station_files(spark, str(tmp_path), readers.schema_from_descriptor(DESCRIPTOR)["daily"], strict=False)
    assert [tuple(r) for r in readers.corrupt_rows(df).collect()] == [("a.csv", "A,2001-02-03,warm")] and df.count() == 2


def test_bad_value_fails_strict_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text("location,date,value,source\nA,2000-01-01,warm,era5\n")
    schema = readers.schema_from_descriptor(DESCRIPTOR)["daily"]
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_station_files(spark, str(tmp_path), schema).collect()
    assert readers.read_station_files(spark, str(tmp_path), schema, strict=False).first().value is None


def test_unknown_source_fails(spark):
    df = spark.createDataFrame([("era5", dt.date(2000, 1, 1), 1.0), ("forecast", dt.date(2000, 1, 2), 1.0)], "source string, date date, t double")
    full = df.select("source", "date", F.lit(0.0).alias("elevation_diff_m"), *[F.col("t").alias(c) for c in ("temperature_max", "temperature_min", "temperature_mean")])
    today = F.to_date(F.lit("2000-01-01"))
    assert readers.station_rows(full, ["era5", "era5t"], today).count() == 1
    with pytest.raises(Exception, match="unrecognised source value: forecast"):
        readers.station_rows(full, ["era5", "era5t"], F.to_date(F.lit("2000-01-05"))).collect()


def test_newest_files_and_hashes(spark, tmp_path):
    import os
    for name, stamp in (("Koper_1950.csv", 1000), ("Koper_1990.csv", 2000), ("Celje_1950.csv", 1500), ("notes.txt", 1)):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (stamp, stamp))
    got = {r.name: r.path.rsplit("/", 1)[1] for r in readers.newest_files(spark, str(tmp_path), r"^([A-Za-z]+)_\d+\.csv$").collect()}
    assert got == {"Koper": "Koper_1990.csv", "Celje": "Celje_1950.csv"}
    hashes = readers.content_hashes(spark, str(tmp_path))
    assert {r.name: r.sha1 for r in hashes.collect()}["notes.txt"] == hashlib.sha1(b"notes.txt").hexdigest()
    manifest = hashes.filter("name != 'notes.txt'")
    assert [r.name for r in change.changed_inputs(hashes, manifest).collect()] == ["notes.txt"]


def test_ascii_grid_files(spark, tmp_path):
    (tmp_path / "t21961jan.asc").write_text("ncols 2\nnrows 2\nx 0\ny 0\ncell 1\nNODATA -9999\n1.5 2\n-9999 4\n")
    rows = {(r.x, r.y): r.value for r in readers.read_ascii_grids(spark, str(tmp_path)).collect()}
    assert rows == {(0, 0): 1.5, (1, 0): 2.0, (0, 1): -9999.0, (1, 1): 4.0}


def test_csv_export_writes_empty_nulls_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.005, [1, 2]), ("b", "x", None, [])], "k string, s string, v double, a array<int>").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"), digits=2)
    made = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert made.splitlines()[0] == "k,s,v,a" and 'a,,1.01,"[1,2]"' in made
    assert "b,x,,[]" in made


def test_publish_is_gated(spark, tmp_path):
    df = spark.createDataFrame([("A", f"2000-01-{d:02d}", float(d)) for d in range(1, 29)], "era5_name string, date string, v double")
    clean = quality.unique_key(df, "daily", ["era5_name", "date"])
    sinks.publish({"daily": df}, lambda staged: clean, str(tmp_path))
    assert sinks.published(spark, str(tmp_path))["daily"].filter("date = '2000-01-05'").first().v == 5.0
    twice = df.unionByName(df)
    with pytest.raises(quality.QualityError, match="28 violation"):
        sinks.publish({"daily": twice}, lambda staged: quality.unique_key(staged["daily"], "daily", ["era5_name", "date"]), str(tmp_path))
    assert sinks.published(spark, str(tmp_path))["daily"].count() == 28


def test_a_write_that_fails_half_way_leaves_all_old_tables(spark, tmp_path):
    names = [f"t{k}" for k in range(10)]
    root, clean = str(tmp_path / "p"), lambda staged: quality.missing_tables(spark, names, names)
    with pytest.raises(LookupError):
        sinks.published(spark, root)
    tables = lambda v: {n: spark.range(5).withColumn("v", F.lit(v)) for n in names}
    assert sinks.publish(tables(1), clean, root) == 1
    written = []

    class Breaks(Exception):
        pass

    def breaking(staged):
        real = DataFrameWriter.parquet

        def parquet(writer, path, *rest, **options):
            if "/versions/" in path:
                if len(written) == 5:
                    raise Breaks
                written.append(path)
            return real(writer, path, *rest, **options)
        patch.setattr(DataFrameWriter, "parquet", parquet)
        return clean(staged)
    with pytest.MonkeyPatch.context() as patch, pytest.raises(Breaks):
        sinks.publish(tables(2), breaking, root)
    assert len(written) == 5
    assert {n: df.first().v for n, df in sinks.published(spark, root).items()} == dict.fromkeys(names, 1)
    assert sinks.publish(tables(3), clean, root) == 2
    assert {df.first().v for df in sinks.published(spark, root).values()} == {3}
    assert {df.first().v for df in sinks.published(spark, root, 1).values()} == {1}
    assert sinks.retire(spark, root, keep=1) == [sinks.versions(spark, root).filter("number = 1").first().folder]
    assert not list((tmp_path / "p" / "versions").glob("00000001-*/t3")) and sinks.published(spark, root)["t3"].first().v == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.published(spark, root, 1)


def test_documentation(spark):
    schema = readers.schema_from_descriptor(DESCRIPTOR)["daily"]
    df = sinks.documented(spark.createDataFrame([("A", 1.0)], "location string, value double"), schema)
    assert {r.column: (r.title, r.unit) for r in sinks.column_documentation(df, "daily").collect()} == {"location": ("Station", None), "value": ("Temperature", "degC")}


def test_materialize_uses_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    got = session.materialize(spark.range(3))
    assert got.count() == 3 and all(named in f for f in got.inputFiles())


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(k, k * 2, "x") for k in range(50)], "k int, a int, b string")
    hashes = lambda d: {r.column: r.hash for r in change.fingerprints(d, "t", ["k"]).collect()}
    base = hashes(df)
    assert hashes(df.orderBy(F.desc("k")).repartition(7)) == base
    moved = hashes(df.withColumn("a", F.when(F.col("k") == 7, None).otherwise(F.col("a"))))
    assert moved["a"] != base["a"] and moved["b"] == base["b"]
    assert hashes(df.withColumn("a", F.when(F.col("k") == 7, 16).when(F.col("k") == 8, 14).otherwise(F.col("a"))))["a"] != base["a"]


def test_manifest_gate(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, a int, trend int")
    old = change.fingerprints(df, "tropical", ["k"])
    drift = change.compare_manifests(change.fingerprints(df.withColumn("trend", F.lit(9)), "tropical", ["k"]), old, [("tropical", "trend")])
    change.manifest_gate(drift)
    assert {r.column: r.status for r in drift.collect()}["trend"] == "informational"
    with pytest.raises(ValueError, match="tropical#a moved"):
        change.manifest_gate(change.compare_manifests(change.fingerprints(df.withColumn("a", F.lit(9)), "tropical", ["k"]), old))


def test_manifest_round_trip(spark, tmp_path):
    made = change.fingerprints(spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), "daily", ["k"])
    change.write_manifest(made, str(tmp_path / "m"))
    assert {r.status for r in change.compare_manifests(made, change.read_manifest(spark, str(tmp_path / "m"))).collect()} == {"ok"}


def test_json_differences_of_lists_nested_values_and_others(spark):
    cases = [('{"b": {"y": 2, "x": [1, 2]}, "a": 1}', '{"a":1,"b":{"x":[1,2],"y":2}}', None), ("[1, 2, 3]", "[1, 2]", "length 3 vs 2"), ("[1, 2]", "[1, 9]", "[1]: 2 vs 9"),
             ('[{"k": [1, {"m": null}]}]', '[{"k": [1, {"m": false}]}]', "[0].k[1].m: null vs false"), ('{"a": null}', "{}", None), ('{"a": 1}', '{"a": "1"}', 'a: 1 vs "1"'),
             ('{"a": {"b": 1}}', '{"a": [1]}', 'a: {"b":1} vs [1]'), ("1", "2", None), ("[1]", '{"0": 1}', None), ("no", "{}", None), (None, "{}", None), ("[]", "[]", None),
             ('{"a": {"b": {"c": {"d": {"e": 1}}}}}', '{"a": {"b": {"c": {"d": {"e": 2}}}}}', 'a.b.c.d: {"e":1} vs {"e":2}'),
             (str(list(range(12))), str([*range(11), 0]), "[11]: 11 vs 0"), ('{"": 1}', '{"": 2}', ": 1 vs 2")]
    df = spark.createDataFrame(cases, "x string, y string, want string")
    got = [(r.x, r.y, r.difference) for r in change.first_json_difference(df, "x", "y").collect()]
    assert got[:-1] == cases[:-1] and got[-1][2].endswith("1 vs 2")


def test_a_json_column_that_fails_names_itself(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": [2]}'), (2, None), (3, "null"), (4, "{broken"), (5, "[1]")], "k int, trend_json string")
    read = lambda k: df.filter(F.col("k") == k).select(text.json_column("trend_json", "struct<a:int,b:array<int>>").alias("v")).first().v
    assert read(1) == (1, [2]) and read(2) is None and read(3) is None
    for k, why in ((4, "column trend_json: no JSON: .broken"), (5, "column trend_json: not struct")):
        with pytest.raises(Exception, match=why):
            read(k)


def test_first_json_difference(spark):
    df = spark.createDataFrame([('{"a":1,"b":2}', '{"b":3,"a":1}'), ('{"a":1}', '{"a":1}'), ('{"a":1}', '{"a":1,"c":2}')], "x string, y string")
    assert [r.difference for r in change.first_json_difference(df, "x", "y").collect()] == ["b: 2 vs 3", None, "c: null vs 2"]


def test_projection_block(spark):
    cells = [(r, c, str(float(r * 100 + c))) for r in range(23, 44) for c in range(20, 67)]
    out = emissions.projections(spark.createDataFrame(cells, "row int, col int, raw string"))
    rows = {r.year: r for r in out.filter("scenario = 'current'").collect()}
    assert sorted(rows) == list(range(2020, 2051))
    assert rows[2020].transport == 2720.0 and rows[2025].transport == 2721.0 and rows[2022].transport == pytest.approx(2720.4)
    assert rows[2020].others == 2920.0 + 3020.0
    assert out.select("scenario").distinct().count() == 6 and "Join" not in out._jdf.queryExecution().toString()


def test_no_number_from_a_partial_sum(spark):
    first, second = emissions.HISTORICAL_OTHERS
    cells = [(2000, first, "3"), (2000, second, "NO"), (2001, first, "3"), (2001, second, "4"), (2002, second, "4"), (2003, emissions.WASTE["total"], "7")]
    made = emissions.historical(spark.createDataFrame(cells, "year int, code int, raw string"))
    assert {r.year: r.others for r in made["historical"].collect() if r.year < 2003} == {2000: None, 2001: 7.0, 2002: None}
    assert [(r.year, r.total) for r in made["waste"].collect()] == [(2003, 7.0)]


def test_first_lines_come_without_a_sort_of_all_lines(spark, tmp_path):
    texts = {"a": "x,y\n" + "1,2\n" * 50, "b": "", "c": "\nz\n1\n", "d": "only", "e": "x,y\n3,4\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for size in ("1", "7", before):
        spark.conf.set(key, size)
        try:
            heads = readers.first_lines(spark, str(tmp_path))
            got = [(r["file"].rsplit("/", 1)[1], r["head"]) for r in heads.collect()]
        finally:
            spark.conf.set(key, before)
        assert sorted(got) == [("a.csv", "x,y"), ("c.csv", ""), ("d.csv", "only"), ("e.csv", "x,y")]
        plan = heads._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan

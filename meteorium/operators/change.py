"""Change detection: column fingerprints, manifest gate and row diffs.

A fingerprint must not depend on row order, because Spark has none.  Every cell is hashed together with its row key and
the hashes of a column are added up, which combines on the map side and needs no sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _cell_hash(key: Column, value: Column) -> Column:
    """First 60 bits of sha256 of key and value as an exact number."""
    text = F.concat(key, F.lit("\x1f"), F.coalesce(value.cast("string"), F.lit("\x00")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")


def fingerprints(df: DataFrame, table: str, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per column: table, column, n_rows, hash."""
    cols = columns or df.columns
    k = F.concat_ws("\x1e", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])
    keyed = df.select(k.alias("_k"), *cols)
    sums = keyed.agg(F.count(F.lit(1)).alias("n_rows"),
                     *[F.coalesce(F.sum(_cell_hash(F.col("_k"), F.col(c))), F.lit(0)).alias(f"_h{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_h{i}").cast("string").alias("hash"))
                      for i, c in enumerate(cols)])
    return (sums.select("n_rows", F.explode(cells).alias("_c"))
            .select(F.lit(table).alias("table"), F.col("_c")["column"].alias("column"), "n_rows",
                    F.col("_c")["hash"].alias("hash")))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One row per published column, so the manifest is a small text table in table and column order."""
    manifest.select("table", "column", "hash").orderBy("table", "column").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "table string, column string, hash string"
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def compare_manifests(actual: DataFrame, expected: DataFrame, excluded: list[tuple[str, str]] = ()) -> DataFrame:
    """Status per table and column: ok, moved, informational (moved but excluded), missing or unknown."""
    a = actual.select("table", "column", F.col("hash").alias("actual"))
    e = expected.select("table", "column", F.col("hash").alias("expected"))
    skip = F.lit(False)
    for t, c in excluded:
        skip = skip | ((F.col("table") == t) & (F.col("column") == c))
    status = (F.when(F.col("expected").isNull(), "missing").when(F.col("actual").isNull(), "unknown")
              .when(F.col("expected") == F.col("actual"), "ok").when(skip, "informational").otherwise("moved"))
    return a.join(e, ["table", "column"], "full_outer").withColumn("status", status)


def manifest_gate(compared: DataFrame) -> None:
    """Raise when a gated column moved or the column sets differ."""
    all_bad = compared.filter(F.col("status").isin("moved", "missing", "unknown")).select("table", "column", "status")
    bad = all_bad.take(100)
    if bad:
        raise ValueError(f"manifest mismatch in {all_bad.count()} column(s), first: " + ", ".join(f"{r['table']}#{r['column']} {r['status']}" for r in bad))


def row_diff(current: DataFrame, reference: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Differing cells of two tables aligned by key: key, column, current, reference (null-safe)."""
    c = current.select(*key, *[F.col(x).cast("string").alias(f"_c_{x}") for x in columns], F.lit(1).alias("_in_c"))
    r = reference.select(*key, *[F.col(x).cast("string").alias(f"_r_{x}") for x in columns], F.lit(1).alias("_in_r"))
    both = c.join(r, key, "full_outer")
    absent = F.col("_in_c").isNull() | F.col("_in_r").isNull()
    cells = F.array(F.when(absent, F.struct(F.lit("<row>").alias("column"),
                                            F.when(F.col("_in_c").isNotNull(), "present").alias("current"),
                                            F.when(F.col("_in_r").isNotNull(), "present").alias("reference"))),
                    *[F.when(~absent & ~F.col(f"_c_{x}").eqNullSafe(F.col(f"_r_{x}")),
                             F.struct(F.lit(x).alias("column"), F.col(f"_c_{x}").alias("current"),
                                      F.col(f"_r_{x}").alias("reference"))) for x in columns])
    return (both.select(*key, F.explode(F.filter(cells, lambda s: s.isNotNull())).alias("_d"))
            .select(*key, "_d.*"))


def first_diffs(diff: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first ``n`` differing rows per column in key order, with the column's total.

    The filter on ``row_number`` keeps at most ``n`` rows per column and task before the shuffle; totals are a separate
    map-side count.
    """
    w = Window.partitionBy("column").orderBy(*key)
    top = diff.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return top.join(diff.groupBy("column").agg(F.count(F.lit(1)).alias("differing")), "column")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _show(value: Column) -> Column:
    """Canonical JSON text of a VARIANT: keys in order, no blanks; what is not there shows as null."""
    return F.coalesce(F.to_json(value), F.lit("null"))


def _parts(value: Column) -> Column:
    """``struct<kind, size, at>`` of a VARIANT: object, list or scalar, and its members by key or by padded place."""
    members, items = F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")
    placed = F.map_from_entries(F.transform(items, lambda x, i: F.struct(F.format_string("%010d", i), x)))
    kind = F.when(members.isNotNull(), "object").when(items.isNotNull(), "list").otherwise("scalar")
    return F.struct(kind.alias("kind"), F.size(items).alias("size"), F.coalesce(members, placed).alias("at"))


def _difference(left: Column, right: Column, depth: int) -> Column:
    """``struct<path, text>`` of the first difference of two VARIANT values that differ."""
    here = F.struct(F.lit("").alias("path"), F.concat(_show(left), F.lit(" vs "), _show(right)).alias("text"))
    if depth == 0:
        return here

    def walk(p: Column) -> Column:
        a, b = p["a"], p["b"]
        keys = F.array_sort(F.array_union(F.map_keys(a["at"]), F.map_keys(b["at"])))
        first = F.get(F.filter(keys, lambda k: _show(F.try_element_at(a["at"], k)) != _show(F.try_element_at(b["at"], k))), F.lit(0))
        label = lambda k: F.when(a["kind"] == "list", F.concat(F.lit("["), k.cast("int").cast("string"), F.lit("]"))).otherwise(k)

        def below(k: Column) -> Column:
            inner = _difference(F.try_element_at(a["at"], k), F.try_element_at(b["at"], k), depth - 1)
            joint = lambda d: F.when((d["path"] == "") | d["path"].startswith("["), "").otherwise(".")
            return _let(inner, lambda d: F.struct(F.concat(label(k), joint(d), d["path"]).alias("path"), d["text"].alias("text")))
        lengths = F.struct(F.lit("").alias("path"), F.concat(F.lit("length "), a["size"].cast("string"), F.lit(" vs "), b["size"].cast("string")).alias("text"))
        return (F.when((a["kind"] != b["kind"]) | (a["kind"] == "scalar"), here)
                .when((a["kind"] == "list") & (a["size"] != b["size"]), lengths).otherwise(_let(first, below)))

    return _let(F.struct(_parts(left).alias("a"), _parts(right).alias("b")), walk)


def first_json_difference(df: DataFrame, left: str, right: str, name: str = "difference", depth: int = 4) -> DataFrame:
    """First difference of two JSON texts as ``path: a vs b``: keys in order, then list places, down to ``depth`` levels.

    Values are compared typed and as a whole (1 is not "1"; the order of keys and blanks do not count), and a missing key equals null.
    Lists of different length differ by it.  Null when the two are equal, when one of them is no JSON, or when they are not
    both objects or both lists.
    """
    a, b = F.try_parse_json(left), F.try_parse_json(right)
    both = lambda p: (p["a"]["kind"] == p["b"]["kind"]) & (p["a"]["kind"] != "scalar")
    comparable = _let(F.struct(_parts(a).alias("a"), _parts(b).alias("b")), both)
    text = _let(_difference(a, b, depth), lambda d: F.concat(d["path"], F.when(d["path"] == "", "").otherwise(": "), d["text"]))
    return df.withColumn(name, F.when(a.isNotNull() & b.isNotNull() & (_show(a) != _show(b)) & comparable, text))


def changed_inputs(files: DataFrame, manifest: DataFrame, name: str = "name", digest: str = "sha1") -> DataFrame:
    """Inputs whose content hash is not in the manifest."""
    return files.join(manifest.select(name, digest), [name, digest], "left_anti")

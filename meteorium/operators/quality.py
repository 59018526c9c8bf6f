"""Data-quality rules.

A rule set turns a table into rows of ``(table, rule, key, column, value)``, one per violation.  All row rules of a
table are evaluated in one scan; group rules add one aggregation each.  Nothing stops at the first error: the gate
counts the violations of all tables together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series as ser


@dataclass(frozen=True)
class RowRule:
    """``bad`` is true for a violating row; ``column`` names the reported value, ``needs`` further columns that ``bad`` reads."""

    name: str
    column: str
    bad: Column
    needs: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return [*self.column.split(","), *self.needs]


REPORT = "table string, rule string, key string, column string, value string"


class QualityError(Exception):
    """Raised by the gate, with a bounded sample of the violations."""


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _key(columns: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(_text(c), F.lit("null")) for c in columns])


def report(df: DataFrame, table: str, rule: str | Column, key: Column, column: str | Column, value: Column) -> DataFrame:
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select(F.lit(table).alias("table"), as_col(rule).alias("rule"), key.alias("key"),
                     as_col(column).alias("column"), value.cast("string").alias("value"))


# ---- row rules -----------------------------------------------------------------------------------------------------

def not_null(column: str) -> RowRule:
    return RowRule("not_null", column, F.col(column).isNull())


def in_range(column: str, low: float, high: float) -> RowRule:
    return RowRule("in_range", column, ~F.col(column).between(low, high))


def at_least(column: str, low: float) -> RowRule:
    return RowRule("at_least", column, F.col(column) < low)


def one_of(column: str, allowed: list) -> RowRule:
    return RowRule("one_of", column, ~F.col(column).isin(allowed))


def castable(column: str, dtype: str) -> RowRule:
    return RowRule("castable", column, F.col(column).isNotNull() & F.col(column).try_cast(dtype).isNull())


def non_decreasing(columns: list[str]) -> RowRule:
    """Columns must not fall from left to right, e.g. percentiles or min <= mean <= max."""
    pairs = [F.col(a) > F.col(b) for a, b in zip(columns, columns[1:])]
    return RowRule("non_decreasing", ",".join(columns), reduce(lambda a, b: a | b, pairs))


def parseable_json(column: str) -> RowRule:
    return RowRule("parseable_json", column, F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull())


def parseable_date(column: str) -> RowRule:
    return RowRule("parseable_date", column,
                   F.col(column).isNull() | ~F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$")
                   | F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd")).isNull())


def maps_to(key: str, column: str, mapping: dict[str, str]) -> RowRule:
    """``column`` must hold the mapped value of ``key``."""
    expected = reduce(lambda acc, kv: acc.when(F.col(key) == kv[0], F.lit(kv[1])), list(mapping.items())[1:],
                      F.when(F.col(key) == next(iter(mapping)), F.lit(mapping[next(iter(mapping))])))
    return RowRule("maps_to", column, ~F.col(column).eqNullSafe(expected), (key,))


def implies_range(when: Column, column: str, low: float, high: float, needs: tuple[str, ...] = ()) -> RowRule:
    return RowRule("implies_range", column, when & ~F.col(column).between(low, high), needs)


def holds(name: str, column: str, good: Column, needs: tuple[str, ...] = ()) -> RowRule:
    """Any row predicate that must hold (null counts as holding; ``not_null`` reports nulls)."""
    return RowRule(name, column, ~good, needs)


# The kinds of the fields of served rows, by place, and of a live station's record, by path.
STATION_ROW = ["number", "string", "string", "string", "number", "string", "number", "number", "number"]
PERCENTILE_ROW = ["number", "number", "string", *["number"] * 9]
LIVE_STATION = {
    "$.station.id": "string", "$.station.name": "string", "$.station.coordinate.latitude": "number", "$.station.coordinate.longitude": "number",
    "$.station.coordinate.altitude": "number", "$.condition.timestamp": "string", "$.condition.temperature": "number", "$.statistics.timestamp": "string",
    "$.statistics.temperature_average_24h": "number", "$.statistics.temperature_min_24h": "number", "$.statistics.temperature_max_24h": "number",
    "$.statistics.timestamp_temperature_min_24h": "string", "$.statistics.timestamp_temperature_max_24h": "string"}
KINDS = {"number": r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)", "string": "^STRING", "boolean": "^BOOLEAN", "list": "^ARRAY", "object": "^OBJECT"}


def _is_kind(value: Column, kind: str) -> Column:
    """Whether a VARIANT value is there and of a kind (a number is a number, not its text)."""
    return F.coalesce(F.schema_of_variant(value).rlike(KINDS[kind]), F.lit(False))


def row_shape(column: str, kinds: list[str]) -> RowRule:
    """JSON text must be a list of exactly these kinds; null is no list."""
    items = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "array<variant>")
    fields = [_is_kind(F.get(items, F.lit(k)), kind) for k, kind in enumerate(kinds)]
    return RowRule("row_shape", column, ~F.coalesce((F.size(items) == len(kinds)) & reduce(lambda a, b: a & b, fields), F.lit(False)))


def record_shape(column: str, paths: dict[str, str]) -> RowRule:
    """JSON text must be a record that has a value of the given kind at each path; other fields may be there."""
    record = F.try_parse_json(F.col(column))
    fields = [_is_kind(F.try_variant_get(record, path, "variant"), kind) for path, kind in paths.items()]
    return RowRule("record_shape", column, ~F.coalesce(reduce(lambda a, b: a & b, fields), F.lit(False)))


def positive_count_matches(column: str, array_json: str) -> RowRule:
    """The count column equals the number of positive entries of a JSON integer array."""
    n = F.size(F.filter(F.from_json(F.col(array_json), "array<int>"), lambda v: v > 0))
    return RowRule("positive_count_matches", column, F.col(column) != n, (array_json,))


def row_violations(df: DataFrame, table: str, key: list[str], rules: list[RowRule]) -> DataFrame:
    """All row rules in one scan.

    A rule whose columns are not all there can't run; each such column is reported as missing, and the other rules run.
    """
    have = set(df.columns)
    lost = sorted({c for r in rules for c in r.columns()} - have | set(key) - have)
    if lost:
        runnable = [r for r in rules if have.issuperset(r.columns())]
        absent = df.sparkSession.createDataFrame([(table, "missing_column", c, c, None) for c in lost], REPORT)
        kept = [c for c in key if c in have]
        return absent.unionByName(row_violations(df, table, kept, runnable)) if runnable else absent

    def value(rule):
        names = rule.column.split(",")
        return F.concat_ws(",", *[F.coalesce(_text(c), F.lit("null")) for c in names])
    cells = F.array(*[F.when(r.bad, F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"),
                                             value(r).alias("value"))) for r in rules])
    hit = df.select(_key(key).alias("key"), F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("_v"))
    return report(hit, table, F.col("_v")["rule"], F.col("key"), F.col("_v")["column"], F.col("_v")["value"])


# ---- group and table rules ---------------------------------------------------------------------------------------

def unique_key(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return report(dup, table, "unique_key", _key(key), ",".join(key), F.col("_n"))


def group_size(df: DataFrame, table: str, group: list[str], expected: int) -> DataFrame:
    bad = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") != expected)
    return report(bad, table, "group_size", _key(group), ",".join(group), F.col("_n"))


def constant_per_group(df: DataFrame, table: str, group: list[str], column: str) -> DataFrame:
    """One value per group; minimum and maximum are enough to tell and combine on the map side."""
    bad = (df.groupBy(*group).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
           .filter(F.col("_lo") != F.col("_hi")))
    return report(bad, table, "constant_per_group", _key(group), column, F.concat_ws("..", _text("_lo"), _text("_hi")))


def daily_continuity(df: DataFrame, table: str, entity: list[str], date: str) -> DataFrame:
    checked = ser.continuity(df, entity, date).withColumn("_k", _key(entity))
    cells = F.array(F.when(F.col("duplicates") > 0, F.struct(F.lit("duplicate_days").alias("r"), F.col("duplicates").alias("n"))),
                    F.when(F.col("missing") > 0, F.struct(F.lit("missing_days").alias("r"), F.col("missing").alias("n"))))
    hit = checked.select("_k", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("_c"))
    return report(hit, table, F.col("_c")["r"], F.col("_k"), date, F.col("_c")["n"])


def increasing_dates(df: DataFrame, table: str, entity: list[str], sequence: str, date: str) -> DataFrame:
    return report(ser.order_inversions(df, entity, sequence, date), table, "increasing_dates",
                  _key([*entity, sequence]), date, F.col(date))


def subset_of(df: DataFrame, table: str, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Ids that the other table does not know."""
    ids = df.select(F.col(column).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    other = known.select(F.col(known_column).alias("_id")).distinct()
    return report(ids.join(other, "_id", "left_anti"), table, "subset_of", _text("_id"), column, F.col("_id"))


def expected_entities(df: DataFrame, table: str, column: str, expected: DataFrame, expected_column: str) -> DataFrame:
    """Missing and unexpected entities, both ways."""
    got = df.select(F.col(column).alias("_id")).distinct()
    want = expected.select(F.col(expected_column).alias("_id")).distinct()
    return (report(want.join(got, "_id", "left_anti"), table, "missing_entity", _text("_id"), column, F.col("_id"))
            .unionByName(report(got.join(want, "_id", "left_anti"), table, "unexpected_entity", _text("_id"), column,
                                F.col("_id"))))


def entity_count(df: DataFrame, table: str, column: str, expected: int) -> DataFrame:
    n = df.agg(F.count_distinct(column).alias("_n")).filter(F.col("_n") != expected)
    return report(n, table, "entity_count", F.lit("all"), column, F.col("_n"))


def equals_config(df: DataFrame, table: str, key: str, config: DataFrame, columns: list[str]) -> DataFrame:
    """Every column equals the configured one (null-safe), in both directions."""
    left = df.select(key, *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(True).alias("_in_l"))
    right = config.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_in_r"))
    both = left.join(right, key, "full_outer")
    absent = F.col("_in_l").isNull() | F.col("_in_r").isNull()
    cells = F.array(F.when(absent, F.struct(F.lit(key).alias("c"), F.when(F.col("_in_l").isNull(), "missing")
                                            .otherwise("unexpected").alias("v"))),
                    *[F.when(~absent & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")),
                             F.struct(F.lit(c).alias("c"), _text(f"_l_{c}").alias("v"))) for c in columns])
    hit = both.select(_text(key).alias("_k"), F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("_c"))
    return report(hit, table, "equals_config", F.col("_k"), F.col("_c")["c"], F.col("_c")["v"])


def same_bounds(df: DataFrame, table: str, group: str, low: str, high: str, source: DataFrame, year: str) -> DataFrame:
    """Published year bounds equal the year span of the source rows."""
    span = source.groupBy(group).agg(F.min(year).alias("_lo"), F.max(year).alias("_hi"))
    have = df.groupBy(group).agg(F.min(low).alias("_a"), F.max(low).alias("_b"), F.min(high).alias("_c"), F.max(high).alias("_d"))
    bad = have.join(span, group, "left").filter(
        F.col("_lo").isNull() | (F.col("_a") != F.col("_lo")) | (F.col("_b") != F.col("_lo"))
        | (F.col("_c") != F.col("_hi")) | (F.col("_d") != F.col("_hi")))
    return report(bad, table, "same_bounds", _text(group), f"{low},{high}", F.concat_ws("..", _text("_a"), _text("_d")))


def monotone(df: DataFrame, table: str, group: list[str], driver: str, index: str) -> DataFrame:
    """The index must not fall when the group's rows are ordered by its driver (groups hold one row per year)."""
    w = Window.partitionBy(*group).orderBy(driver, index)
    bad = df.withColumn("_before", F.lag(index).over(w)).filter(F.col(index) < F.col("_before"))
    return report(bad, table, "monotone", _key([*group, driver]), index, F.col(index))


def not_collapsed(df: DataFrame, table: str, group: list[str], column: str) -> DataFrame:
    """A series of two or more rows must not be constant."""
    bad = (df.groupBy(*group).agg(F.count(column).alias("_n"), F.min(column).alias("_lo"), F.max(column).alias("_hi"))
           .filter((F.col("_n") >= 2) & (F.col("_lo") == F.col("_hi"))))
    return report(bad, table, "not_collapsed", _key(group), column, F.col("_lo"))


def array_series(df: DataFrame, table: str, key: list[str], left: str, right: str) -> DataFrame:
    """Parallel arrays have equal length and the value array is not constant."""
    return row_violations(df, table, key, [
        RowRule("equal_length", f"{left},{right}", F.size(left) != F.size(right)),
        RowRule("not_collapsed", right, (F.size(right) >= 2) & (F.array_min(right) == F.array_max(right)))])


def untrusted_published(df: DataFrame, table: str, key: list[str], trend: str = "trend", ok: str = "fit_ok") -> DataFrame:
    """No trend may be published from a fit that does not trust itself."""
    return row_violations(df.withColumn("_t", F.to_json(trend)), table, key,
                          [RowRule("untrusted_published", "_t", F.col(trend).isNotNull() & ~F.col(ok))])


def column_set(df: DataFrame, table: str, declared: list[str]) -> DataFrame:
    """Exact column set: one row per missing or undeclared column (schema only, no data is read)."""
    rows = [(table, "missing_column", c, c, None) for c in declared if c not in df.columns]
    rows += [(table, "undeclared_column", c, c, None) for c in df.columns if c not in declared]
    return df.sparkSession.createDataFrame(rows, REPORT)


def missing_tables(spark, have: list[str], expected: list[str]) -> DataFrame:
    rows = [(t, "missing_table", t, None, None) for t in expected if t not in have]
    return spark.createDataFrame(rows, REPORT)


def all_of(reports: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


def summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("table", "rule", "column").agg(F.count(F.lit(1)).alias("violations"))


def gate(violations: DataFrame, sample: int = 50) -> None:
    """Raise when there is any violation.  The totals cover all violations; the driver receives at most ``sample`` rows."""
    first = violations.take(sample)
    if first:
        total, rules = summary(violations).agg(F.sum("violations"), F.count(F.lit(1))).first()
        lines = [f"{r['table']}: {r['rule']} [{r['column']}] key={r['key']} value={r['value']}" for r in first]
        raise QualityError(f"{total} violation(s) in {rules} rule(s)\n  - " + "\n  - ".join(lines))


def all_or_nothing(df: DataFrame, group: list[str], dimension: DataFrame, n_name: str = "n_entities") -> DataFrame:
    """Mark pooled groups: complete when every entity of the dimension is present, partial otherwise."""
    expected = dimension.agg(F.count(F.lit(1))).scalar()
    return df.withColumn("pool", F.when(F.col(n_name) == expected, "complete").otherwise("partial"))


def require_complete_pool(df: DataFrame) -> DataFrame:
    """Fail the query on any partial pool instead of returning a biased mean."""
    ok = F.when(F.col("pool") == "partial", F.raise_error(F.lit("partial pool: national mean would be biased")))
    return df.filter(ok.cast("boolean").isNull())


def frequency_sanity(df: DataFrame, key: list[str], bins: str, n_samples: str, n_entities: str) -> DataFrame:
    """Bins and totals of expected day counts against the per-entity sample (array ``bins``)."""
    ceiling = F.col(n_samples) / F.col(n_entities)
    return row_violations(
        df.withColumns({"_top": F.array_max(bins), "_sum": F.aggregate(bins, F.lit(0).cast("bigint"), lambda a, b: a + b)}),
        "frequency", key,
        [RowRule("bin_above_sample", "_top", F.col("_top") > F.ceil(ceiling * 1.02)),
         RowRule("total_above_sample", "_sum", F.col("_sum") > F.ceil(ceiling * 1.1))])

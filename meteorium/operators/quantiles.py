"""Percentiles and percentile ranks.

* ``yearly_percentiles``: Spark's exact ``percentile`` for groups that are bounded by the calendar.
* ``exact_percentiles``: exact percentiles of groups of any size.  It never brings a group together: values are counted
  per (group, value), cut into buckets by an approximate sketch, and only the few buckets that hold the wanted ranks
  are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def yearly_percentiles(df: DataFrame, group: list[str], value: str, cuts: dict[str, float],
                       min_samples: int = 1) -> DataFrame:
    """Linear-interpolated percentiles of the non-null values of calendar-bounded groups."""
    ps = F.percentile(value, F.array(*[F.lit(p) for p in cuts.values()]))
    return (df.filter(F.col(value).isNotNull()).groupBy(*group)
            .agg(F.count(value).alias("n_samples"), ps.alias("_p"))
            .filter(F.col("n_samples") >= min_samples)
            .select(*group, "n_samples", *[F.col("_p")[i].alias(n) for i, n in enumerate(cuts)]))


def exact_percentiles(df: DataFrame, group: list[str], value: str, cuts: dict[str, float], levels: int = 8,
                      task_rows: int = 1_000_000) -> DataFrame:
    """Exact linear-interpolated percentiles, safe for groups that hold a large share of all rows.

    Rows are counted per (group, value) on the map side.  Then rounds narrow the values down: a mergeable sketch gives
    ``2 ** levels - 1`` splitters per group, running totals over the bucket sums (a few hundred rows) find the buckets
    that hold the wanted ranks, and only these buckets go on.  A round divides the values by about ``2 ** levels``; when
    no bucket has more than ``task_rows`` values, running counts inside the buckets give the order statistics.
    Any splitters give the right answer, good ones only make the buckets even.
    """
    v = F.col(value).cast("double")
    counted = materialize(df.filter(v.isNotNull()).groupBy(*group, v.alias("_v"))
                          .agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0).cast("bigint")))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("cut"), F.lit(float(p)).alias("p")) for n, p in cuts.items()]))
    ranks = (counted.groupBy(*group).agg(F.sum("_n").alias("_total")).withColumn("_c", wanted)
             .withColumn("_pos", (F.col("_total") - 1) * F.col("_c")["p"])
             .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
             .select(*group, F.lit(0).cast("bigint").alias("_k"), F.col("_c")["cut"].alias("cut"), "_pos", "_total", "_rank"))
    part = [*group, "_k"]

    def largest(rows: DataFrame) -> int:
        return rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0

    while largest(counted) > task_rows:
        counted, ranks = _narrow(counted, ranks, part, levels)

    inside = Window.partitionBy(*part).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    spans = (counted.withColumn("_hi", F.sum("_n").over(inside)).withColumn("_lo", F.col("_hi") - F.col("_n"))
             .select(*part, "_v", "_lo", "_hi"))
    hits = ranks.join(spans, part).filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    solved = (hits.groupBy(*group, "cut", "_pos", "_total").agg(F.min("_v").alias("_l"), F.max("_v").alias("_h"))
              .withColumn("value", F.col("_l") + (F.col("_h") - F.col("_l")) * (F.col("_pos") - F.floor("_pos"))))
    return solved.groupBy(*group).agg(F.max("_total").alias("n_samples"),
                                      *[F.max(F.when(F.col("cut") == n, F.col("value"))).alias(n) for n in cuts])


def _narrow(counted: DataFrame, ranks: DataFrame, part: list[str], levels: int) -> tuple[DataFrame, DataFrame]:
    """One round: keep the buckets that hold a wanted rank; ranks become relative to their bucket."""
    buckets = 2 ** levels
    inner = [i / buckets for i in range(1, buckets)]
    # sketches merge in any order, so the splitters are fixed before several plans read them
    splits = materialize(counted.groupBy(*part).agg(
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in inner]), 4 * buckets).alias("_s")))
    cut = counted.join(splits, part).withColumn("_b", F.lit(0))
    for step in (2 ** k for k in range(levels - 1, -1, -1)):  # binary search for the splitters below the value
        cut = cut.withColumn("_b", F.col("_b") + F.when(F.get("_s", F.col("_b") + step - 1) < F.col("_v"), step).otherwise(0))
    cut = cut.drop("_s")
    order = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = (cut.groupBy(*part, "_b").agg(F.sum("_n").alias("_t")).withColumn("_end", F.sum("_t").over(order))
            .withColumn("_start", F.col("_end") - F.col("_t")).drop("_t"))
    located = materialize(ranks.join(sums, part).filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
                          .withColumn("_rank", F.col("_rank") - F.col("_start")).drop("_start", "_end"))
    chosen = located.select(*part, "_b").distinct()
    deeper = (F.col("_k") * buckets + F.col("_b")).alias("_k")
    rest = [c for c in ranks.columns if c != "_k"]
    kept = cut.join(chosen, [*part, "_b"], "left_semi").select(*[c for c in part if c != "_k"], deeper, "_v", "_n")
    return materialize(kept), located.select(*rest, deeper)


def strict_percent_rank(df: DataFrame, group: list[str], value: str, name: str, reference=None) -> DataFrame:
    """Percent of the group's reference values strictly below each row's value (all values if there are none).

    For calendar-bounded groups.  A range frame that ends just below the current value counts the smaller values.
    """
    ref = F.lit(True) if reference is None else reference
    below = Window.partitionBy(*group).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*group, value)
    all_rows = Window.partitionBy(*group)

    def share(flag):
        one = F.when(flag, 1).otherwise(0)
        return (F.sum(one).over(below) - F.sum(one).over(peers)) / F.sum(one).over(all_rows) * 100

    n_ref = F.sum(F.when(ref, 1).otherwise(0)).over(all_rows)
    return df.withColumn(name, F.when(n_ref > 0, share(ref)).otherwise(share(F.lit(True))))


def rank_against_sample(requests: DataFrame, samples: DataFrame, group: list[str], value: str,
                        name: str, array: str = "samples") -> DataFrame:
    """Rounded percent of an ascending sample array strictly below the request's value."""
    joined = requests.join(samples, group, "left")
    below = F.size(F.filter(array, lambda s: s < F.col(value)))
    return joined.withColumn(name, F.floor(below / F.size(array) * 100 + 0.5).cast("int")).drop(array)

"""URL filter: host and path rules, and for the rest a tree of path templates per host.

Rules label the URLs that they fit.  The method judges the others:

* Paths become templates.  Segments lose their numbers and hexadecimal ids; then, level by level and per host, a branch with very many
  children is variable, whatever the number of pages below them.  Its children without labels become one wildcard.  Those with labels join it if at
  least half of all children have labels, so that a few labelled ones do not speak for the rest; one that differs from the
  labelled others stays by itself.
* Children of one branch whose shares of blocked labels don't differ from those of their labelled siblings by more than chance (a
  two-proportion test) are merged into one.
* A template is rejected if its share of blocked labels, smoothed towards the share of all labels, is above one half.  A template
  without labels is never rejected.

All steps are joins and combined counts over distinct templates, of which there are far fewer than pages; pages only meet the result.

Edge cases: a null URL, or one without ``://``, has empty host and path and is allowed; an empty path has an empty template; segments below
``DEPTH`` are one; a path counts once, however many rows have it, and all are judged alike; without any label nothing is rejected; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import lower_ascii

#: Levels of a tree; what lies deeper is one segment.
DEPTH = 8
#: A branch is variable with more children than this.
CHILDREN = 20
#: Two shares differ if they are this many standard errors apart.
APART = 1.96
#: Weight, in labels, of the share of all labels.
WEIGHT = 2.0


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Of the rules (verdict, host with path) that fit, verdict and rule with the longest text; null if none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Segments of a path without numbers and hexadecimal ids; the deepest one holds all that lies deeper."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*(?![0-9A-Za-z])", "{id}"), r"[0-9]+", "{n}")
    parts = F.split(F.regexp_replace(plain, "^/", ""), "/", -1)
    deep = F.concat(F.slice(parts, 1, DEPTH - 1), F.array(F.array_join(F.slice(parts, F.lit(DEPTH), F.size(parts)), "/")))
    return F.when(F.size(parts) > DEPTH, deep).otherwise(parts)


def template_table(pages: DataFrame) -> DataFrame:
    """host, raw (segments as they stand in the pages), kept (their template), n, labelled, blocked per distinct template of a host.

    ``pages`` has host, path and label (1 blocked, 0 allowed, null unknown).
    """
    raw = segments(F.col("path"))
    table = materialize(pages.select("host", raw.alias("raw"), "label").groupBy("host", "raw")
                        .agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked"))
                        .withColumn("kept", F.col("raw")))
    levels = table.agg(F.max(F.size("kept"))).first()[0] or 0
    for level in range(levels):
        table = materialize(_level(table, level))
    return table


def _level(table: DataFrame, level: int) -> DataFrame:
    """The table with the segments of one level made wildcards or merged where that holds."""
    here = table.filter(F.size("kept") > level).select("host", F.slice("kept", 1, level).alias("branch"), F.col("kept")[level].alias("child"), "labelled", "blocked")
    child = here.groupBy("host", "branch", "child").agg(*(F.sum(c).alias(c) for c in ("labelled", "blocked")))
    whole = child.groupBy("host", "branch").agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("labelled") > 0).alias("with_labels"),
                                                 *(F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")))
    rest, rest_blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    pooled = F.col("all_blocked") / F.col("all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest))
    compared = (F.col("labelled") > 0) & (rest > 0)
    alike = compared & (F.abs(F.col("blocked") / F.col("labelled") - rest_blocked / rest) <= APART * error)
    joins = (F.col("labelled") == 0) | ((2 * F.col("with_labels") >= F.col("children")) & (~compared | alike))
    new = F.when((F.col("children") > CHILDREN) & joins, F.lit("{*}")).when(alike, F.lit("{~}"))
    change = child.join(whole, ["host", "branch"]).withColumn("new", new).filter("new IS NOT NULL").select("host", "branch", "child", "new")
    keyed = table.withColumn("branch", F.slice("kept", 1, level)).withColumn("child", F.when(F.size("kept") > level, F.col("kept")[level]))
    swapped = F.concat("branch", F.array("new"), F.slice("kept", F.lit(level + 2), F.greatest(F.size("kept") - level - 1, F.lit(0))))
    return (keyed.join(change, ["host", "branch", "child"], "left").withColumn("kept", F.when(F.col("new").isNotNull(), swapped).otherwise(F.col("kept")))
            .select("host", "raw", "kept", "n", "labelled", "blocked"))


def purities(table: DataFrame) -> DataFrame:
    """host, raw, kept, labelled and purity: the smoothed share of blocked labels of the template, null without labels."""
    share = table.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = (share["b"] or 0) / share["l"] if share["l"] else 0.0
    kept = table.groupBy("host", "kept").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = F.when(F.col("labelled") > 0, (F.col("blocked") + WEIGHT * prior) / (F.col("labelled") + WEIGHT))
    return table.select("host", "raw", "kept").join(kept, ["host", "kept"]).select("host", "raw", "kept", "labelled", purity.alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, template, purity and verdict of every page."""
    url = F.coalesce(F.col("address"), F.lit(""))
    seen = (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("address")).withColumn("host", host_of(url)).withColumn("path", path_of(url))
            .withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
            .select("id", "host", "path", "found.rule", F.col("found.verdict").alias("said"), segments(F.col("path")).alias("raw")))
    label = F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("int"))
    table = purities(template_table(seen.select("host", "path", label.alias("label")).distinct()))
    judged = seen.join(table, ["host", "raw"], "left")
    method = F.when(F.col("purity") > 0.5, "block").otherwise("allow")
    return judged.select("id", "host", "path", "rule", F.array_join("kept", "/").alias("template"), "purity", F.coalesce("said", method).alias("verdict"))

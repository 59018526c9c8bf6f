"""Secrets in texts: known forms, and strings that a battery of randomness tests can't tell from random ones.

A candidate of the battery is a longest run of 20 or more characters of one alphabet, with ``=`` only as padding at its end, that holds a digit and a
letter and doesn't overlap a known form.  So ``NAME=value`` has a name and a value, and a token behind a path or a prefix is tested with them and without.
Its encoding is the smallest alphabet that holds it.  A candidate inside a longer one that is reported is not reported again.  Under the hypothesis of even independent characters three scores are standard
normal, nearly: chi-squared of the character counts, number of runs above and below the middle of the alphabet, and serial correlation of
neighbours.  The sum of their squares gives a p-value, evenly spread for random strings and near 0 for written ones.

False discoveries are held down per encoding and length class (powers of two), since short strings tell little: the p-values above one half
say how many random strings there are; of the strings above a bound, those beyond the random ones' share are false.  The
lowest bound with at most ``rate`` of them false is used; a class without such a bound reports nothing.  The counts of a class of fewer than ``FEW``
strings say little, so there the bound is at most ``rate`` itself, which all but that share of random strings pass.

Only Column expressions run here.  Edge cases: a null text counts as empty; no match gives no spans; nulls in other columns do not
matter; rows that repeat are judged each on its own but all count in the bounds; a very long text is one row, worked through whole.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .spans import MATCHES, let, matches

#: The known forms. ``size`` is the least number of characters of the group.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: Alphabets by name, smallest first, each with the pattern of a string written in it.
ALPHABETS = [("hex", "0123456789abcdef", "[0-9a-f]+"), ("HEX", "0123456789ABCDEF", "[0-9A-F]+"), ("base32", string.ascii_uppercase + "234567", "[A-Z2-7]+=*"),
             ("base36", string.digits + string.ascii_lowercase, "[0-9a-z]+"), ("base62", string.digits + string.ascii_uppercase + string.ascii_lowercase, "[0-9A-Za-z]+"),
             ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", "[A-Za-z0-9+/]+=*"),
             ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_", "[A-Za-z0-9_-]+=*")]
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_=-]))?" % LEAST
#: Longest runs of each alphabet inside a candidate run.
RUNS = [pattern.replace("]+", "]{%d,}" % LEAST).replace("=*", "(?:=+$)?") for _, _, pattern in ALPHABETS]
BINS = 20
#: Strings of a class from which its own counts give the bound.
FEW = 20

_SPAN = "array<struct<start:int,end:int,kind:int>>"


def _found(text: Column, gate: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """Spans of one kind; the gate is a cheap test that any text with a match passes."""
    spans = F.transform(F.filter(matches(text, pattern, group), keep), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(gate, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three known forms by start, then kind.

    A run that is too short can't hold a longer match of the forms ``access`` and ``hex``, so these ask for the full length at once.
    """
    gate = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN)
    assign = _found(text, gate, ASSIGN, 0, lambda m: F.length(m["part"]) >= 8, 1)
    access = _found(text, F.contains(text, F.lit("AKIA")), ACCESS[:-1] + "{12,}", 1, lambda m: F.lit(True))
    hexes = _found(text, text.rlike(HEX[:-1] + "{32}"), HEX[:-1] + "{32,}", 2, lambda m: F.lit(True))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(0)
    return F.array_sort(F.concat(assign, access, hexes), order)


def candidates(text: Column, base: Column) -> Column:
    """Strings that may be encoded bytes, outside the known forms, as start, end and value: an array for each run of all alphabets."""
    def usable(m: Column) -> Column:
        return m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    def inside(run: Column) -> Column:
        moved = lambda m: F.struct((run["start"] + m["start"]).alias("start"), (run["start"] + m["end"]).alias("end"), m["value"].alias("value"), m["part"].alias("part"))
        return F.array_distinct(F.flatten(F.array(*(F.transform(matches(run["value"], p), moved).cast(MATCHES) for p in RUNS))))
    found = F.transform(matches(text, CANDIDATE), lambda run: F.filter(inside(run), usable))
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(f"array<{MATCHES}>"))


def _erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by a rational approximation, error below 2e-7."""
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + c
    return poly * t * F.exp(-x * x)


def randomness(value: Column, alphabet: Column) -> Column:
    """p-value of the hypothesis that the characters are even and independent."""
    def tested(s: Column) -> Column:
        chars, letters = s["chars"], s["letters"]
        a, n = F.length(letters).cast("double"), F.size(chars).cast("double")
        codes = F.transform(chars, lambda c: F.instr(letters, c).cast("double") - 1)
        squares = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.array_join(F.array_remove(chars, c), "")), F.lit(2.0)))
        chi = (a / n * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (1 - 1 / n))

        def of_codes(v: Column) -> Column:
            pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
            changes = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + ((p["x"] < a / 2) != (p["y"] < a / 2)).cast("double"))
            middle = (a - 1) / 2
            product = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["x"] - middle) * (p["y"] - middle))
            runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
            serial = product / ((a * a - 1) / 12 * F.sqrt(n - 1))
            return let(chi * chi + runs * runs + serial * serial, lambda q: _erfc(F.sqrt(q / 2)) + F.sqrt(2 * q / math.pi) * F.exp(-q / 2))
        return let(codes, of_codes)
    return let(F.struct(F.split(value, "").alias("chars"), alphabet.alias("letters")), tested)


def judged(found: Column) -> Column:
    """Candidates with encoding, length class and p-value; strings in no known alphabet are left out."""
    def one(m: Column) -> Column:
        name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
        for n, alphabet, pattern in reversed(ALPHABETS):
            fits = m["value"].rlike(f"^{pattern}$")
            name, letters = F.when(fits, n).otherwise(name), F.when(fits, alphabet).otherwise(letters)
        core = F.regexp_replace(m["value"], "=+$", "")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), name.alias("encoding"), F.floor(F.log2(F.length(core))).cast("int").alias("size_class"),
                        F.when(name.isNotNull() & (F.length(core) > 2), randomness(core, letters)).alias("p"))
    return F.filter(F.transform(found, one), lambda m: m["p"].isNotNull())


def bounds(tested: DataFrame, rate: float = 0.05) -> DataFrame:
    """encoding, size_class and the lowest p-value bin that is reported there; a few hundred rows at most."""
    level = F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int")
    counts = tested.select(F.explode(F.flatten("tested")).alias("t")).groupBy("t.encoding", "t.size_class", level.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("encoding", "size_class").agg(F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).alias("high"), F.sum("n").alias("strings"))
    grid = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1)))).join(counts, ["encoding", "size_class", "bin"], "left")
    above = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("encoding", "size_class").orderBy(F.desc("bin")))
    random = F.col("high") * 2 * (1 - F.col("bin") / BINS)
    few = (F.col("strings") < FEW) & (F.col("bin") >= math.ceil(rate * BINS))
    return (grid.withColumn("passed", above).filter(few | (F.col("passed") > 0) & (F.greatest(F.lit(0.0), F.col("passed") - random) <= rate * F.col("passed")))
            .groupBy("encoding", "size_class").agg(F.min("bin").alias("least_bin")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """id, base and spans of every row: arrays of start, end and kind (a place in ``KINDS``), by start, then kind."""
    text = F.coalesce(F.col("body"), F.lit(""))
    first = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).withColumn("base", base_spans(text))
    tested = materialize(first.select("id", "base", F.transform(candidates(text, F.col("base")), judged).alias("tested")))
    # at most encodings x length classes rows, so they can stand in the plan as a literal map
    least = F.create_map(*(F.lit(v) for r in bounds(tested, rate).collect() for v in (f"{r['encoding']}:{r['size_class']}", r["least_bin"]))).cast("map<string,int>")
    level = lambda m: F.least(F.floor(m["p"] * BINS), F.lit(BINS - 1))
    high = lambda run: F.filter(run, lambda m: F.coalesce(level(m) >= least[F.concat_ws(":", m["encoding"], m["size_class"].cast("string"))], F.lit(False)))
    holds = lambda o, m: (o["start"] <= m["start"]) & (o["end"] >= m["end"]) & (o["end"] - o["start"] > m["end"] - m["start"])
    passed = F.flatten(F.transform("tested", lambda run: let(high(run), lambda one: F.filter(one, lambda m: ~F.exists(one, lambda o: holds(o, m))))))
    random = F.transform(passed, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(3).alias("kind"))).cast(_SPAN)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(0)
    return tested.select("id", "base", F.array_sort(F.concat("base", random), order).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

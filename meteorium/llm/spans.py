"""Places of pattern matches and rendered parts as Column expressions, without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def upto(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running(numbers: Column) -> Column:
    """For each number the sum of those before it; blocks keep very long arrays from taking the square of their length."""
    def by_block(held: Column) -> Column:
        blocks = F.transform(upto(F.ceil(F.size(held) / _BLOCK).cast("int")), lambda b: total(F.slice(held, b * _BLOCK + 1, F.lit(_BLOCK))))
        def all_before(sums: Column) -> Column:
            heads = F.transform(upto(F.size(sums)), lambda b: total(F.slice(sums, F.lit(1), b)))
            return let(heads, lambda h: F.transform(upto(F.size(held)), lambda i: h[F.floor(i / _BLOCK).cast("int")] + total(
                F.slice(held, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))
        return let(blocks, all_before)
    return let(numbers, by_block)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end (exclusive, in characters), value and part (the group's text) of the leftmost matches that don't overlap.

    The text is cut at the matches; what lies between them gives their places.
    """
    found, cut = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(values: Column, gaps: Column, inner: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), F.length(v).alias("size")))
        starts = running(F.transform(steps, lambda s: s["gap"] + s["size"]))
        return F.zip_with(F.zip_with(starts, steps, lambda before, s: F.struct((before + s["gap"]).alias("start"), (before + s["gap"] + s["size"]).alias("end"))),
                          F.arrays_zip(values.alias("value"), inner.alias("part")),
                          lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v["value"].alias("value"), v["part"].alias("part")))
    return let(F.struct(found.alias("v"), cut.alias("g"), parts.alias("p")), lambda a: placed(a["v"], a["g"], a["p"]))


def placed_parts(texts: Column) -> Column:
    """Start of each text when they all stand one after another."""
    return running(F.transform(texts, F.length))


MATCHES = "array<struct<start:int,end:int,value:string,part:string>>"

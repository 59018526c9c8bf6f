"""Text clean-up and guarded JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(html) -> Column:
    """Remove everything between ``<`` and the next ``>`` on one line."""
    return F.regexp_replace(_c(html), r"<.*?>", "")


def strip_brackets(text) -> Column:
    return F.regexp_replace(_c(text), r"[\[\]\s]", "")


def compact_date(text) -> Column:
    """First ``14 Apr 2023`` in a text as ``20230414``; null when there is none or it is no date."""
    found = F.regexp_extract(_c(text), r"(\d{1,2} \w{3} \d{4})", 1)
    return F.date_format(F.try_to_timestamp(F.when(found != "", found), F.lit("d MMM yyyy")), "yyyyMMdd")


def json_ok(text) -> Column:
    """True for parseable JSON text."""
    return F.try_parse_json(_c(text)).isNotNull()


def json_column(column: str, ddl: str) -> Column:
    """A column's JSON text as a value of a type; text that is no JSON, or not of that type, fails the query and names the column."""
    text = F.col(column)

    def failed(why: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"column {column}: {why}: "), F.substring(text, 1, 80))).cast(ddl)
    value = F.try_variant_get(F.try_parse_json(text), "$", ddl)
    return (F.when(text.isNull(), F.lit(None).cast(ddl)).when(~json_ok(text), failed("no JSON"))
            .when(value.isNull() & (F.trim(text) != "null"), failed(f"not {ddl}")).otherwise(value))


def label_parts(label, separator: str = " ") -> tuple[Column, Column]:
    """First word and the rest of a label."""
    parts = F.split(_c(label), separator)
    return F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), separator)


def display_name(name) -> Column:
    return F.replace(_c(name), F.lit("_"), F.lit(" "))

"""Queries of the license scan."""

from . import licenses
from .common import table


def op1_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_ROWS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"

OP1_SQL = f"""
WITH t AS (SELECT template, license, {_PAIRS.format("w")} AS g FROM
             (SELECT template, license, regexp_extract_all({_LOW.format("body")}, '[a-z0-9]+') AS w FROM (VALUES {_ROWS}) v(template, license, body))),
l AS (SELECT doc_id, 'line' AS kind, i AS number, string_split(text, chr(10))[i + 1] AS part FROM documents, unnest(range(0, len(string_split(text, chr(10))))) u(i)),
b AS (SELECT doc_id, 'block' AS kind, i AS number, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')[i + 1] AS part
      FROM documents, unnest(range(0, len(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')))) u(i)),
p AS (SELECT doc_id, kind, CAST(number AS INTEGER) AS number, {_PAIRS.format("w")} AS g FROM
        (SELECT doc_id, kind, number, regexp_extract_all({_LOW.format("part")}, '[a-z0-9]+') AS w
         FROM (SELECT * FROM l UNION ALL SELECT * FROM b WHERE contains(trim(part), chr(10)))) WHERE len(w) > 1),
m AS (SELECT doc_id, kind, number, license, template, len(list_intersect(p.g, t.g)) AS c, len(p.g) + len(t.g) AS s FROM p JOIN t
      ON len(p.g) * 3 >= len(t.g) * 2 AND len(p.g) * 2 <= len(t.g) * 3)
SELECT doc_id, kind, number, license, template, 2.0::DOUBLE * c / s AS dice FROM m WHERE 200 * c >= 80 * s
"""

QUERIES = {"op1_license_scan": (op1_license_scan, OP1_SQL)}

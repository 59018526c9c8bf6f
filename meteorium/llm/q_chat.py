"""Queries of the preference formatting."""

from . import preferences
from .common import table


def op4_preferences(spark, sf_dir):
    return preferences.preference_pairs(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t,
                  list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS raw
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT coalesce(a.conv_id >> 1, b.conv_id >> 1) AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.t AS a, b.t AS b,
             coalesce(list_position(list_transform(range(1, least(len(a.raw), len(b.raw)) + 2), lambda i: i > least(len(a.raw), len(b.raw)) OR a.raw[i] IS DISTINCT FROM b.raw[i]), true) - 1, 0) AS n
      FROM (SELECT * FROM c WHERE conv_id & 1 = 0) a FULL JOIN (SELECT * FROM c WHERE conv_id & 1 = 1) b ON a.conv_id >> 1 = b.conv_id >> 1),
r AS (SELECT *, list_transform(a, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS ra,
             list_transform(b, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS rb FROM p)
SELECT pair_id, chosen_id, rejected_id, CAST(n AS INTEGER) AS n_common, coalesce(array_to_string(ra[1:n], ''), '') AS prompt,
       CASE WHEN a IS NOT NULL THEN array_to_string(ra[n + 1:], '') END AS chosen,
       CASE WHEN a IS NOT NULL THEN array_to_string(list_transform(list_filter(range(n + 1, len(a) + 1), lambda i: a[i].role = 'assistant'),
            lambda i: (length(array_to_string(ra[n + 1:i - 1], '')) + 13 + length(a[i].role))::VARCHAR || ':' || (length(array_to_string(ra[n + 1:i], '')) - 1)::VARCHAR), ',') END AS chosen_mask,
       CASE WHEN b IS NOT NULL THEN array_to_string(rb[n + 1:], '') END AS rejected,
       CASE WHEN b IS NOT NULL THEN array_to_string(list_transform(list_filter(range(n + 1, len(b) + 1), lambda i: b[i].role = 'assistant'),
            lambda i: (length(array_to_string(rb[n + 1:i - 1], '')) + 13 + length(b[i].role))::VARCHAR || ':' || (length(array_to_string(rb[n + 1:i], '')) - 1)::VARCHAR), ',') END AS rejected_mask
FROM r
"""

QUERIES = {"op4_preferences": (op4_preferences, OP4_SQL)}

"""Queries of the n-gram Jaccard join."""

from pyspark.sql import functions as F

from . import prefix_tree_join
from .common import table


def op5_ngram_join(spark, sf_dir):
    return prefix_tree_join.near_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
c AS (SELECT min(doc_id) AS rep, len(any_value(s)) AS n, list(doc_id) AS ids, k, any_value(s) AS s FROM (SELECT doc_id, s, array_to_string(list_sort(s), chr(10)) AS k FROM s) GROUP BY k),
g AS MATERIALIZED (SELECT rep, n, hash(unnest(s)) AS g FROM c WHERE n > 0),
r AS MATERIALIZED (SELECT rep, n, g, row_number() OVER (PARTITION BY rep ORDER BY f, g) AS pos FROM g JOIN (SELECT g, count(*) AS f FROM g GROUP BY g) USING (g)),
p AS (SELECT rep, n, g FROM r WHERE pos <= n - ceil(0.9 * n) + 1),
cand AS (SELECT DISTINCT a.rep AS u, b.rep AS v FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
lk AS MATERIALIZED (SELECT u, v FROM (SELECT u, v, a.n AS an, b.n AS bn, len(list_intersect(a.s, b.s)) AS o FROM cand JOIN c a ON a.rep = u JOIN c b ON b.rep = v)
       WHERE 100 * o >= 90 * (an + bn - o)),
e AS (SELECT u, v FROM lk UNION ALL SELECT v, u FROM lk),
reach AS (SELECT u AS node, u AS got FROM (SELECT DISTINCT u FROM e) UNION SELECT reach.node, e.v FROM reach JOIN e ON reach.got = e.u),
comp AS (SELECT node, min(got) AS component FROM reach GROUP BY node)
SELECT unnest(ids) AS doc_id, n AS n_shingles, CASE WHEN n = 0 THEN unnest(ids) ELSE coalesce(component, rep) END AS component_id
FROM c LEFT JOIN comp ON node = rep
"""

QUERIES = {"op5_ngram_join": (op5_ngram_join, OP5_SQL)}

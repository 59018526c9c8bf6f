"""Queries of the exact-copy operator."""

from pyspark.sql import functions as F

from . import exact_dedup
from .common import table


def op10_exact_dedup(spark, sf_dir):
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), every_row=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

QUERIES = {"op10_exact_dedup": (op10_exact_dedup, OP10_SQL)}

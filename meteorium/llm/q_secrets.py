"""Queries of the secret scan."""

from pyspark.sql import functions as F

from . import secrets
from .common import table


def op7_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])  # F.filter would hand a second parameter of its function the place, not the kind
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select(F.col("id").alias("doc_id"), *count, F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


QUERIES = {"op7_secrets": (op7_secrets, None)}

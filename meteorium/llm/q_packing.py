"""Queries of the packing operator."""

from . import packing
from .common import table


def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op3_packing": (op3_packing, None)}

"""Queries of the two trained operators."""

from pyspark.sql import functions as F

from . import language, toxicity
from .common import crc_mod, table


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 3)
    model = language.fit(docs.filter(rest != 1))
    return language.predict(docs, model, keep=[F.col("doc_id"), (rest == 1).alias("held_out")])


def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = crc_mod(F.col("doc_id"), 4)
    model = toxicity.fit(docs, labels.filter(rest != 2))
    return toxicity.score(docs, model, keep=[F.col("doc_id"), (rest == 2).alias("held_out")]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op6_language": (op6_language, None), "op9_toxicity": (op9_toxicity, None)}

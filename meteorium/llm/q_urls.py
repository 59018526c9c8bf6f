"""Queries of the URL filter."""

from . import url_filter
from .common import table

#: The rules of the query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


QUERIES = {"op8_url_filter": (op8_url_filter, None)}

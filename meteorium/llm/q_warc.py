"""Query of the web archives."""

from . import warc
from .common import table


def op11_warc(spark, sf_dir):
    index = warc.archive_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(x, (5 * k + 1)::INT, 5))::BIGINT) AS b FROM s)
SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(b, lambda v: [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1),
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1),
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1)])), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

QUERIES = {"op11_warc": (op11_warc, OP11_SQL)}

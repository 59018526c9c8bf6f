import duckdb
import pytest

import __spark_entry__ as entry
from tools import check

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["daily_percentiles", "theil_sen", "threshold_days", "season_ranks", "yearly_interpolation", "upsert", "fingerprints", "flood_extent"]


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity", "slot", "n_samples", "p05", "p20", "p40", "p60", "p80", "p95"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(entry.oracle_sql()) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    problem, _ = check.compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert not problem

"""Every registered query of the security operators against its SQL in DuckDB, over whole tables."""

import decimal

import duckdb
import pytest

from watchloom import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = own.QUERIES[name](spark, SF)
    want = duck.sql(own.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(x) for x in r]) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    assert rows == sorted(repr([plain(x) for x in r]) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_queries_without_sql(spark):
    assert set(own.QUERIES) - set(own.ORACLE) == {"anomaly_scores", "forest_detection", "vector_topk_index"}
    told = own.QUERIES["forest_detection"](spark, SF).first()
    assert told.attack_n + told.clean_n == spark.read.parquet(f"{SF}/events.parquet").count() and told.clean_rate <= 12 and told.verdict in ("GOOD", "FAIR", "POOR")
    scores = own.QUERIES["anomaly_scores"](spark, SF)
    assert scores.filter("score between 0 and 100").count() == spark.read.parquet(f"{SF}/events.parquet").count()

"""Every query with SQL against DuckDB, every other one for its shape."""

from decimal import Decimal

import duckdb
import pytest

from terrasift.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_entry_and_contract(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_permit_reads_whole_text(spark, tmp_path):
    """What stands beyond the first 200 characters counts."""
    spark.createDataFrame([(3, "x " * 300 + "revised permit to operate")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["doc_permit_type"](spark, str(tmp_path)).collect() == [(3, "FESOP / operating permit", "Revised")]
    assert registry.QUERIES["doc_subject"](spark, str(tmp_path)).collect() == [(3, "Unit 3", 1)]

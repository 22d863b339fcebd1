"""Every engine query at sf0.001 against its DuckDB SQL."""

import duckdb
import pytest

from quillstream.plans import catalogue
from quillstream.session import ship

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    return sorted(tuple("~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    ship(spark)
    found = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = canonical(found.select(*columns).collect())
    if name in catalogue.ORACLE_SQL:
        expected = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(expected.columns) == columns
        assert rows == canonical(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

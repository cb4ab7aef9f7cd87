"""Each query of the library against its SQL."""

import duckdb
import pytest

from assay import queries

TABLES = "region nation customer supplier part orders lineitem events labels documents".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in found.fetchall()) == sorted(tuple(map(plain, r)) for r in df.select(columns).collect())

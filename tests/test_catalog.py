"""Every registered trajectory query against its SQL twin, as the same multiset of rows."""

import duckdb
import pytest

from trackmill.plans import catalog, crossings, ingest, structures  # noqa: F401  the others register their queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, tmp_path, name):
    catalog.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    if name not in catalog.SQL:
        return
    got = db.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    want = db.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    a, b = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", f"SELECT {columns} FROM ({catalog.SQL[name]})"
    for left, right in ((a, b), (b, a)):
        assert db.sql(f"({left}) EXCEPT ALL ({right}) LIMIT 3").fetchall() == []

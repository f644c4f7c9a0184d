"""Queries of this subpackage that have SQL, against DuckDB."""

import duckdb
import pytest
from papyra.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = db.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    rows = sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())

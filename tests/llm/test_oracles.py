"""Queries of the training-data operators against their SQL in DuckDB."""

import duckdb
import pytest

from tracelake.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    c = duckdb.connect(config={"temp_directory": ""})
    for t in ("documents", "pages", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    want = sorted(repr(tuple(x for _, x in sorted(zip(names, row)))) for row in r.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(x[n] for n in sorted(names))) for x in df.collect()) == want

"""Every registered query of the library against its DuckDB oracle, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(pdf, columns):
    out = pdf[columns].copy()
    for c in columns:
        if out[c].dtype.kind in "iuf":
            out[c] = out[c].astype(float).round(6) + 0.0
    return sorted(map(tuple, out.astype(str).replace({"None": "nan", "<NA>": "nan"}).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert normal(got, columns) == normal(want, columns)

"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

from decimal import Decimal
from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from docengine.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(df: pd.DataFrame, cols: list[str]) -> list[tuple]:
    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "\0null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (float, np.floating, Decimal)):  # a nullable column of whole numbers comes as floats
            return str(int(v)) if v == v // 1 and abs(v) < 1 << 53 else repr(float(v))
        return str(int(v)) if isinstance(v, Number) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got, sorted(got.columns)) == cells(want, sorted(got.columns))


def test_entry_imports(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

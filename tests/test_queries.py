"""Every query of the library that has SQL gives the rows that DuckDB gives for it."""

import functools
import os

import duckdb
import pandas as pd
import pytest

from leafspark import registry
from leafspark.plans import structure_queries
from tests.conftest import SF_DIR


def normal(frame):
    def text(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.9g}"
        return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(text(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def run_sql(sql, sf_dir=SF_DIR):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con.execute(sql).df()


@pytest.fixture(scope="module", autouse=True)
def structure_once():
    """All queries of page structure read the same lines and paragraphs, made once."""
    made = functools.cache(structure_queries._structure)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(structure_queries, "_structure", made)
        yield


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    got, wanted = normal(registry.QUERIES[name](spark, SF_DIR).toPandas()), normal(run_sql(registry.SQL[name]))
    assert got[0] == wanted[0]
    assert got[1] == wanted[1]


def test_queries_without_sql_are_known():
    """Folds in which a row depends on what was taken or refused before; all have brute-force tests."""
    assert set(registry.QUERIES) - set(registry.SQL) == {"quota_events", "budget_events", "edit_targets"}

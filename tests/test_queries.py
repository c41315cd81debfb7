"""Each query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomery.plans import chats, corpus, evaluation, further, sources, streams

TABLES = "documents labels benchmark conversations pages events".split()
QUERIES = corpus.QUERIES | chats.QUERIES | evaluation.QUERIES | further.QUERIES | sources.QUERIES | streams.QUERIES
ORACLE = corpus.ORACLE | chats.ORACLE | evaluation.ORACLE | further.ORACLE | sources.ORACLE | streams.ORACLE


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def cells(df: pd.DataFrame):
    def plain(x):
        if isinstance(x, float):
            return None if x != x else round(x, 9)
        return None if x is None or x is pd.NA or x is pd.NaT else str(x) if isinstance(x, pd.Timestamp) else x

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_no_part_of_the_library_needs_llm():
    import pathlib

    root = pathlib.Path(corpus.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "loomery.llm" in p.read_text()]

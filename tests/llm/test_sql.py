"""Queries of the llm operators against SQL over the given tables."""

import pandas as pd
import pytest

llm = pytest.importorskip("quadweave.llm.queries")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(spark, duck, sf, name):
    shown = lambda v: "null" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)
    rows = lambda f: sorted(tuple(map(shown, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    got, want = llm.queries()[name](spark, sf).toPandas(), duck.sql(llm.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_queries_cover_them_all():
    assert [n.split("_")[0] for n in llm.queries()] == [f"op{i}" for i in range(1, 14)]

"""Every registered query against the same question in SQL over the base tables."""

import pytest

from quadweave.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def _cell(v):
    if v is None or v != v:
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)

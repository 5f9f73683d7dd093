"""Queries of the subpackage that SQL can express, against DuckDB; the others for running on whole tables."""

import pytest

from citebase.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    rows = QUERIES[name](spark, sf_dir)
    got = sorted(tuple(map(str, r)) for r in rows.collect())
    assert len(got) == len(set(got))
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        order = [columns.index(c) for c in rows.columns]
        assert got == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())

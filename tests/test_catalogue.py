"""Every query with SQL against DuckDB, row for row; the others for running at all."""

import pandas as pd
import pytest

from citebase.plans import catalogue, training

ALL = {**catalogue.QUERIES, **training.QUERIES}
SQL = {**catalogue.ORACLE, **training.ORACLE}


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        try:
            return f"{float(v):.9g}" if not isinstance(v, (bool, str)) else str(v)
        except (TypeError, ValueError):
            return str(v)

    out = frame[sorted(frame.columns)].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, duck, name):
    got = ALL[name](spark, sf_dir).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(plain(got), plain(want))


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 5


def test_rest_stands_without_llm():
    """Nothing outside the subpackage imports it but the entry, which does without."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "citebase"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "citebase.llm" not in p.read_text(), p

"""Every registered query of this package runs, and equals its SQL where it has one."""

import pytest

import ledgerloom.llm as llm
from tests.parity import assert_same


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = llm.QUERIES[name](spark, sf_dir)
    if name in llm.SQL:
        assert_same(df, duck, llm.SQL[name])
    else:
        assert df.columns
        df.count()

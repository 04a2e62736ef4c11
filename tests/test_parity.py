"""Every registered query of the core runs, and equals its SQL where it has one."""

import importlib

import pytest

import __spark_entry__ as entry_module
from tests.parity import assert_same

MODULES = [importlib.import_module(f"ledgerloom.plans.{m}") for m in entry_module.PLANS]
NAMES = sorted(n for m in MODULES for n in m.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    df = module.QUERIES[name](spark, sf_dir)
    if name in module.SQL:
        assert_same(df, duck, module.SQL[name])
    else:
        assert df.columns
        df.count()


def test_entry(spark):
    assert entry_module.entry(spark).count() >= 0


def test_sql_only_for_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

"""Every query of the core with SQL gives the rows of its SQL; the others run."""

import pytest
from oracle import compare, connect

from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, con, name):
    assert compare(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    if name.startswith("tok_train"):
        pytest.skip("needs more words than these tables have; see test_tokenizer")
    assert catalog.queries()[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Queries with SQL give the rows of their SQL; all others run and have rows."""

import pytest
from oracle import compare, connect

from corpusloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, con, name):
    assert compare(spark, con, SF, Q.queries()[name], Q.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["p6_public_budget", "p8_shares"])
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_languages_of_the_buckets(spark):
    """Most buckets are right, so most records must come out as their bucket says."""
    from pyspark.sql import functions as F

    from corpusloom.runtime import table

    made = Q.p1_documents(spark, SF).join(table(spark, SF, "records").select("rid", "bucket"), "rid")
    rows = made.where("bucket in ('bangla', 'banglish', 'english', 'code-mixed') and lang is not null")
    assert rows.agg(F.avg((F.col("lang") == F.col("bucket")).cast("double"))).first()[0] > 0.88

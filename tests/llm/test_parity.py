"""The subpackage's queries against their DuckDB counterparts, and all of them on the smallest data."""

from __future__ import annotations

from pathlib import Path

import pytest

import tools_parity
from occura.llm import queries, sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test data")


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_parity(spark, name):
    assert tools_parity.differences(spark, tools_parity.connect(DATA), DATA, name, sql.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0
    wanted = {"p1_found": ["interview_id", "field_name", "ref_id"], "p8_found": ["doc_id", "para_no", "lang"]}
    assert df.columns == wanted.get(name, df.columns)


def test_cases_of_the_mapping(spark):
    """One row for every interview and field whose stored value settles nothing."""
    i = spark.read.parquet(f"{DATA}/interview.parquet").dropDuplicates(["id"])
    c = spark.read.parquet(f"{DATA}/company_ref.parquet")
    names = [r.company_name for r in c.collect()]
    want = i.where("company_raw IS NOT NULL").where(~i.company_normalized.isin(names) | i.company_normalized.isNull()).count()
    assert queries.p1_found(spark, DATA).where("field_name = 'company'").count() == want

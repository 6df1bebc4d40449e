"""Every registered query of the core against its DuckDB counterpart, on the smallest data."""

from __future__ import annotations

from pathlib import Path

import pytest

import tools_parity
from occura import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test data")
MAY_BE_EMPTY = {"filter_company_of_list", "filter_topic_l1_l2", "redirect_resolve", "filter_position_exact", "files_under_several_documents", "quality_confidence_range", "split_leakage"}


@pytest.fixture(scope="module")
def con():
    return tools_parity.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_parity(spark, con, name):
    why = tools_parity.differences(spark, con, DATA, name, catalogue.oracle_sql()[name])
    assert why == "" or (why == "EMPTY" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

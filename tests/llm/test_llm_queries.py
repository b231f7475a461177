"""Every pN query of the subpackage: against its SQL, or that it runs."""

import os

import pytest
from oracle import DATA, check

from vdjloom.llm.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_columns(spark):
    want = {"p1_found": ["aa_value"], "p2_found": ["group_id", "identity_key"], "p5_found": ["group_id", "primer"], "p7_found": ["doc_id"], "p8_found": ["source"], "p9_found": ["doc_id"]}
    for name, cols in want.items():
        assert QUERIES[name](spark, DATA).columns == cols

"""Every registered query against its SQL oracle on the smallest data."""

import pathlib

import pytest

from armparity.plans.catalog import ORACLES, QUERIES
from harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, problems = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert rows > 0 or name in ORACLES
    assert not problems, problems


#: Queries that SQL cannot express, and the test that holds each against another computation.
TESTED_ELSEWHERE = {"gate_evidence_drawn": "test_gate_bounds", "gate_verdict_drawn": "test_gate_bounds", "shd_compare_aligned": "test_lineage_rungs"}


def test_queries_without_sql_are_tested_elsewhere():
    assert set(QUERIES) - set(ORACLES) == set(TESTED_ELSEWHERE)
    here = pathlib.Path(__file__).parent
    assert all((here / f"{name}.py").exists() for name in TESTED_ELSEWHERE.values())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

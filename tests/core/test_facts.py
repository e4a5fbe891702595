"""Operators against known answers, through Spark and SQL as they are registered."""

import duckdb
import pytest

from athanor.facts import FACTS, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(FACTS))
def test_answers(name):
    operator, cases = FACTS[name]
    assert [(a, operator(a)) for a, _ in cases] == list(cases)


@pytest.mark.parametrize("name", ["mol_kekule_count", "network_views", "search_paths"])
def test_query_equals_sql(spark, name):
    got = sorted(map(tuple, QUERIES[name](spark, "").select("subject", "answer").collect()))
    assert got == sorted(duckdb.sql(ORACLES[name]).fetchall())

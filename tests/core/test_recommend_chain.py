"""Recommendations work their tables' relationships out once."""

import pytest

from keyloom import queries
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["recommend_indexes", "recommendation_records", "recommendation_document"])
def test_one_chain_serves_keys_and_references(spark, monkeypatch, name):
    calls, chain = [], queries._chain
    monkeypatch.setattr(queries, "_chain", lambda *a: calls.append(a) or chain(*a))
    queries.QUERIES[name](spark, DATA)
    assert len(calls) == 1

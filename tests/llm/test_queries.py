import pytest

from millrace.llm import queries as Q
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, data, name):
    same(spark, data, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0


def test_columns(spark, data):
    want = {"p1_found": ["rec_id"], "p2_found": ["rec_id"], "p4_found": ["lo_rec_id", "hi_rec_id"], "p5_found": ["rec_id", "kind"], "p8_found": ["doc_id"]}
    assert {n: Q.QUERIES[n](spark, data).columns for n in want} == want

import pytest

from orthobox.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, sf, con, name):
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(map(str, con.sql(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))

import re

from lodestrata.llm import queries as q


def test_one_query_for_each_operator_and_sql_as_text():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in q.QUERIES) == list(range(1, 14))
    assert set(q.ORACLE_SQL) <= set(q.QUERIES) and all(isinstance(s, str) for s in q.ORACLE_SQL.values())

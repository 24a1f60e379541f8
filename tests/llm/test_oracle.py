import pytest

from usagelens.llm.oracle import ORACLE
from usagelens.llm.queries import QUERIES
from usagelens_checks.compare import duck

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, name):
    found = QUERIES[name](spark, SF)
    columns = found.columns
    cursor = duck(SF).execute(ORACLE[name])
    names = [item[0] for item in cursor.description]
    assert sorted(names) == sorted(columns)
    theirs = sorted(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(row) for row in found.collect()) == theirs

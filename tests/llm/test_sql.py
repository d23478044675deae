import pytest

from lodestar.llm.queries import ORACLE, QUERIES
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_what_its_sql_gives(spark, name):
    sf = "/root/testdata/sf0.01"
    same(QUERIES[name](spark, sf), connect(sf), ORACLE[name])


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))

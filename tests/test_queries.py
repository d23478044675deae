import pytest

from lodestar.plans.registry import ORACLE, QUERIES
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_what_its_sql_gives(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE[name])


def test_repeats_against_brute_force(spark):
    """All spans that the pattern fits, by trying every start and end with Python's engine."""
    import re

    fits = re.compile("(?:th|er){2,4}(?:on|e)*").fullmatch
    want = []
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        s, before = r.text, -1
        for i in range(len(s)):
            ends = [e for e in range(i + 4, min(len(s), i + 60) + 1) if fits(s, i, e)] if s[i : i + 2] in ("th", "er") else []
            if ends:
                if ends[-1] > before:
                    want.append((r.conv_id, r.turn, i, ends[-1] - i))
                before = ends[-1]
    got = [tuple(r) for r in QUERIES["regex_matches_repeat"](spark, SF).collect()]
    assert want and sorted(got) == sorted(want)

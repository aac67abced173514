import pytest

from caseflow.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import oracle_rows, rows_of, tables


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    want = oracle_rows(tables(SF_SMALL), ORACLES[name])
    got = rows_of(df)
    assert got == want and got


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

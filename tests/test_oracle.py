import pytest
from conftest import SMALL
from oracle import same

from verbascope.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    if name in oracle_sql():
        same(spark, SMALL, queries()[name], oracle_sql()[name])
    else:
        queries()[name](spark, SMALL).collect()

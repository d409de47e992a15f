import os

import pytest

from tests import oracle
from weft import registry

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(DIRECTORY)


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_says_what_its_sql_says(spark, db, name):
    oracle.same(registry.queries()[name](spark, DIRECTORY), db, registry.oracle_sql()[name])

import os

import pytest

from tests import oracle
from weft.llm import registry
from weft.llm.oracles import ORACLES

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_says_what_its_sql_says(spark, name):
    oracle.same(registry.queries()[name](spark, DIRECTORY), oracle.connect(DIRECTORY), ORACLES[name])

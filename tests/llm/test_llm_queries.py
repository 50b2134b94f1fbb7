from __future__ import annotations

from pathlib import Path

import pytest

from skein.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        same, note = compare(spark, name, QUERIES[name], SQL[name], SF, connect(SF))
        assert same, note
    else:
        assert QUERIES[name](spark, SF).count() >= 0

"""Every query of the graph against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from graphspark.queries import ORACLES, QUERIES
from tests.helpers import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(name, spark, small_dir, duck):
    same(QUERIES[name](spark, small_dir), duck, ORACLES[name])


def test_entry_gives_rows(spark, small_dir):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "confidence" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

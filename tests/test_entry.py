from __future__ import annotations

import __spark_entry__
from columna.plans import queries


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)

"""Every named query of the training-data operators against its SQL on the smallest tables."""

import compare
import pytest

from quern.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, duck, name):
    columns, rows = compare.spark_rows(queries.QUERIES[name](spark, data))
    if name in queries.SQL:
        expected_columns, expected = compare.sql_rows(duck, queries.SQL[name])
        assert columns == expected_columns
        assert rows == expected
    else:
        assert rows

"""Every query with an SQL twin against it; the registered set is complete."""

import pytest

from auditloom.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference, duck_rows, spark_rows
from tests.conftest import SF_DIR


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    columns, rows, _ = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_columns, expected, _ = duck_rows(connect(SF_DIR), ORACLES[name])
    assert columns == expected_columns
    assert rows == expected, difference(rows, expected)

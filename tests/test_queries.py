"""Every registered query against its SQL twin, on the whole small tables."""

import pytest

from florilege.plans import QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name)
    assert ok, note

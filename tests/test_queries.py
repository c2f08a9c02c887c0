"""Every registered query against its SQL on the smallest tables; those without SQL give rows."""

import pytest

from foliospark.queries import ORACLES, QUERIES

from .conftest import SF
from .helpers import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["doc_id", "n_pages", "md"]
    assert df.count() > 0

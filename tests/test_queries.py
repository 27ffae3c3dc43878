"""Every registered query against its SQL."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, database):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, database, ORACLES[name]) is None
    else:
        assert df.columns and df.count() >= 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)

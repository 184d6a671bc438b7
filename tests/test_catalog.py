"""Every query against its SQL, and the entry points."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.conftest import SF, rows_of
from witnesslake import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows_of(got, cols) == sorted(map(str, want.select(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query that SQL can express, beside its SQL."""

import pytest

import __spark_entry__ as entry
from contestkit.plans import queries as plans

from . import oracle


@pytest.fixture(scope="module")
def connections(sf_dir):
    return {d: oracle.connect(d) for d in (sf_dir, sf_dir.replace("sf0.001", "sf0.01"))}


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, connections, name):
    small, large = connections
    sf_dir = small if "with recursive" in plans.SQL[name] else large  # the database walks bout by bout
    assert oracle.differ(spark, connections[sf_dir], sf_dir, name, plans.QUERIES[name], plans.SQL[name]) is None


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pace_pressure_advantage" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())

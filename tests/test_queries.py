"""Every registered query against its SQL. Written stages are shared between queries here."""

from functools import cache

import oracle_check
import pytest

from cartloom import queries as q
from cartloom.oracle import oracle_sql

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.fixture(scope="module", autouse=True)
def shared_stages():
    patch = pytest.MonkeyPatch()
    for name in ("pinned_carts", "final", "packed"):
        patch.setattr(q, name, cache(getattr(q, name)))
    settings, kept = q.settings, {}
    patch.setattr(q, "settings", lambda spark, sf, rows: kept.setdefault(sf, settings(spark, sf, rows)))
    yield
    patch.undo()


def test_every_query_has_sql():
    assert set(SQL) == set(q.QUERIES)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert oracle_check.differences(q.QUERIES[name](spark, SF), con, SQL[name]) == []


def test_comparison_sees_a_difference(spark, con):
    changed = q.QUERIES["rgb_parse"](spark, SF).withColumn("red", q.F.col("red") + 0.001)
    assert oracle_check.differences(changed, con, SQL["rgb_parse"])

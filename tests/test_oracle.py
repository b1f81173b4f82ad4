"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

from sievelog.plans.catalog import ORACLES, QUERIES
from tests.oracle import ROOT, compare, connect

SF = os.path.join(ROOT, os.environ.get("SIEVELOG_SF", "sf0.001"))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


#: The smallest tables have sixteen positive labels, too few to learn from.
LARGER = {"train_classifier": os.path.join(ROOT, "sf0.01")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    sf = LARGER.get(name, SF)
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(df, connect(sf), ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)

"""Every registered query against its SQL (or, without SQL, that it returns rows) on the smallest tables."""

import pytest

import oracle
from priorline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"lifecycle_training_frame"}))
def test_query(spark, con, name):
    if name in ORACLES:
        verdict = oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
        assert verdict.startswith("OK"), verdict
    else:
        assert QUERIES[name](spark, SF).limit(1).count() == 1

"""Every query with SQL gives exactly the SQL's rows; the others give at least one row."""

import pytest

from tests.conftest import SF
from tidemark.plans import load_all
from tidemark.plans.registry import ORACLES, QUERIES

load_all()
ROWS_ONLY = [n for n in QUERIES if n not in ORACLES]


LARGER = SF.replace("0.001", "0.01")
# Peer groups reach the least size of five only there.
NEED_LARGER = {"wn_group_quantile_band", "wn_clamp_band"}


@pytest.fixture(scope="module")
def con():
    from check_queries import connect

    return {sf: connect(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, con, name):
    from check_queries import compare

    sf = LARGER if name in NEED_LARGER else SF
    assert compare(QUERIES[name](spark, sf), con[sf], ORACLES[name]) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1

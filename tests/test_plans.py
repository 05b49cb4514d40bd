"""Plan shape: what must stay true for the jobs to scale."""

import pytest

from tests.conftest import SF
from tidemark.operators.cleaning import last_k_per_key
from tidemark.plans import adapters as A
from tidemark.plans import load_all
from tidemark.plans.registry import QUERIES, Tables

load_all()
LIGHT = [n for n in QUERIES if n.split("_")[0] in ("cln", "jn", "wn", "ag", "ev", "dr", "tk", "so", "pv", "tx")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_price_metrics_use_one_exchange_per_key(spark):
    text = plan(QUERIES["wn_volatility"](spark, SF))
    # One exchange collapses to days, one gathers each key; windows and the final aggregate reuse it.
    assert text.count("Exchange hashpartitioning(key#") <= 2, text


def test_last_k_is_cut_before_the_shuffle(spark):
    t = Tables(spark, SF)
    text = plan(last_k_per_key(A.records(t).select("Customer_ID", "rec_date", "record_no"), "Customer_ID", A.RECORD_ORDER, 4))
    assert text.count("WindowGroupLimit") == 2


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["wn_recency_and_count"](spark, SF))
    assert "l_comment" not in text and "l_tax" not in text and "l_returnflag" not in text

"""The registered queries against their SQL on the smallest tables, and the contract itself."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle import compare, connect

QUICK = ["audit_lineitem", "profile_orders", "leak_scan", "guard_inputs", "clean_per_fold", "fe_bin", "fold_time", "fold_time_local", "fold_group",
         "fold_strat_group", "holdout", "origins_embargo", "carve_local", "permute_labels", "m_auc", "m_qwk", "m_mcc", "multi_seed_verdict", "ledger_compare",
         "budget_spend", "topk_long", "dedupe_url", "text_features_docs", "profile_examples"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None

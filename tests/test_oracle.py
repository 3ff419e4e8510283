"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from tallyspark.plans.registry import load_all
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
ENTRIES = load_all()
SQL = {k: e.sql for k, e in ENTRIES.items()}
#: Models without SQL; test_rules.py trains them on separable rows.
SLOW = {"noise_robustness", "embedding_lr", "embedding_lr_report", "bow_linear"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(k for k in ENTRIES if k not in SLOW))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, key, E.queries()[key], SQL.get(key), SF, con)
    assert r["ok"] in (True, None), r
    assert r["rows"] >= 0

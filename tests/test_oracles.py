"""Every registered query beside its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casebook import CASES, ORACLES  # noqa: E402
from tools.compare import compare, connect  # noqa: E402

# Fits of many models: minutes of work, checked on small frames in test_models.py instead.
SLOW = {"compare_classifiers", "compare_regressors", "tune_grid"}
# Too few rows at this scale to hold any: these must still agree with their SQL.
MAY_BE_EMPTY = {"tasks_for_agent", "capability_lookup", "execution_stats_filter", "top_findings", "significant_only",
                "high_corr_pairs", "join_hits_to_records", "kb_get", "dispatch_order", "cache_valid"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    found = compare(CASES[name](spark, sf_dir), duck, ORACLES[name])
    assert found is None or (found == "no rows" and name in MAY_BE_EMPTY), found


@pytest.mark.parametrize("name", sorted(set(CASES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert CASES[name](spark, sf_dir).count() > 0

"""The registry is consistent and a spread of queries matches DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests import check

SF = "/root/testdata/sf0.001"
SAMPLE = ["a12_result_store", "b9_preprocess", "b13_entity_hints", "c6_batch_resolve", "c16_co_occurrence", "d2_intent_summary",
          "e1_seasonal_context", "e23_feedback_fold", "f11_internal_convergence", "f13_affinity", "g1_rate_limit_offered", "h4_evaluation"]


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, name):
    note, ok = check.compare(spark, check.duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok or "EMPTY" in note, note

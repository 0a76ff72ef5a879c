"""Queries beside their SQL on the smallest tables (compare.py runs them all at any size)."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from hushframe import plans

FOLDER = "/root/testdata/sf0.001"
# One per operator family; the whole list is the comparison run's work.
SAMPLE = [
    "a7_regions_beside_tables", "a8_read_region", "a12_publish", "b2_cell_predicates", "b4_profile_documents", "c1_policy_verdicts",
    "d8_many_bins", "d11_shared_codes", "e4_utf16_spans", "e6_identifier_hits", "f6_joint_classes_lineitem", "f8_linked_fingerprints",
    "g2_set_digest", "h9_related_restore", "h14_applied_edits", "i6_result_join", "j7_rebuilt_target", "k5_supplied_terms", "k9_round_trip",
]


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


def test_every_query_has_its_statement():
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare.compare(spark, con, FOLDER, name, queries()[name], oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry_runs(spark):
    assert entry(spark).count() == 1

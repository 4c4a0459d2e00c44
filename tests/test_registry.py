"""Every registered query runs and agrees with its SQL, on the smallest tables.

All of them at a larger scale: `python tests/oracle.py /root/testdata/sf0.01`.
"""
import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from workload.registry import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
# heavy on planning grids; run by the script
LONG = {"cheaper_options", "fewest_left_out", "likely_undecided_checks", "outcome_splits", "odds_curves", "batch_plans", "answer_chances",
        "runs_to_decide", "gate_peaks", "value_problems", "meteor_with_stems", "scored_wording_checks", "bleu_scores"}


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query(spark, name):
    problem = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem in (None, "no rows", "no rows on either side")

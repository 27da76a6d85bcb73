"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from check import compare, database

from catalog import load_all

QUERIES, ORACLES = load_all()
# Each fits several models; the other tests cover their parts.
HEAVY = {"i7_downsampled_model", "g4_mice_numeric", "g5_mice_factors", "g7_chain_invariants", "g4_filled_from_observed", "g8_missranger", "i7_binary_model", "i7_test_counts", "i12_fold_sizes", "i12_continuous_model",
         "i13_hurdle_model", "i14_log_error_model"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_query_agrees_with_sql(spark, sf, name):
    text, _, ok = compare(spark, database(sf), sf, name, QUERIES[name], ORACLES.get(name))
    assert ok, text

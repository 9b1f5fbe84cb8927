"""Registered queries against DuckDB; all of them with ``ALL_QUERIES=1``."""

import os

import pytest

import __spark_entry__ as entry_points
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "fim1_itemsets_with_cells", "fim3_generalized_itemsets_level_wise", "met20_beta_t_values", "e2e3_outcome_exploration",
    "tre6_divergence_criterion_d_fpr", "prp11_quantile_bins", "itm15_unmatched_values", "sel10_minimal_itemsets",
    "shp2_global_shapley", "cor4_correction_t_values", "lat3_node_groups", "int4_best_intervals", "e2e5_support_sweep",
]
ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else SOME)
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES.get(name)) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry_points.entry(spark).count() == 10

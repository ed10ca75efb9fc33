"""Registered queries against their oracle SQL in DuckDB."""

import duckdb
import pytest

from check import TABLES, compare
from sightline.plans import all_queries
from tests.conftest import SMALL

QUERIES, ORACLES = all_queries()
CORE = {
    "fidelity_features", "mark_rate", "mean_gap", "group_quantiles", "densify", "scan_delimited", "sink_clustered",
    "capture_history", "jolly_seber", "c_hat", "jackknife_vcv", "mark_rate_correct", "abundance_by_occasion",
    "model_compare", "nearest_line", "point_in_polygon", "point_grid_join", "thin_social", "thin_ferry",
    "pp_loglik", "pixel_rwpci", "curve_band_social", "lloyd_step", "gower_pairs", "silhouette_by_k", "wss_by_k",
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", [
    pytest.param(k, marks=() if k in CORE else pytest.mark.slow) for k in sorted(QUERIES)
])
def test_matches_oracle(spark, con, key):
    ok, note = compare(spark, con, SMALL, key, QUERIES[key], ORACLES.get(key))
    assert ok and "TYPES" not in note, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)

"""A cross-section of the registered queries against SQL; tools/check_oracles.py runs them all."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_oracles  # noqa: E402
from cargolume.catalog import ORACLES, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "fct_shipments_b mart_operations_health_hourly mart_data_quality_hourly overview_operations "
    "merge_new_events minute_metrics_a check_columns validate_events_b detect_refund_spike "
    "analytics_evidence quality_state latency_percentiles rank_fusion chunk_documents"
).split()


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    outcome = check_oracles.compare(spark, con, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert outcome.startswith("ok"), outcome


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)

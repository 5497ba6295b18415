"""Agreement of named queries with their SQL on the smallest tables."""

import os

import pytest
from check_oracle import compare, connect

from wattledger import catalog

SF = "/root/testdata/sf0.001"
QUICK = (
    "at0_policy_totals", "at23_trace_rows", "ij5_coverage_islands", "ij9_guarded_sums", "ij11_combined_total", "sm4_grouping_sets", "rq2_telemetry_gap",
    "val1_outcomes", "ot13_provider_carry", "lc3_stop_sweep", "ct3_session_split", "ob7_watchdog", "vw2_neighbourhood", "st7_stream_pairing",
)
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(QUICK) <= set(catalog.oracle_sql())


@needs_tables
@pytest.mark.parametrize("name", QUICK)
def test_agrees_with_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    cur = connect(SF).execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), names) == ""

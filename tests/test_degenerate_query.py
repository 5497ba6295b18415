"""Queries on events without duration against their SQL."""

import os

import duckdb
import pytest
from check_oracle import compare, connect

from wattledger import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["val16_degenerate_predicate", "ob7_watchdog"])
def test_events_without_duration(spark, folder, name):
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS value,
      CASE WHEN event_id % 15 = 0 THEN '{{"k": 0}}' ELSE props END AS props) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'""")
    df = catalog.queries()[name](spark, folder)
    cur = connect(folder).execute(catalog.oracle_sql()[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) == ""

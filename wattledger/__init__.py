"""Wattledger: energy and footprint accounting for software-agent telemetry, on Spark.

Everything is a function from DataFrames to DataFrames.  Packages:

* ``sources``    - readers for spool lines, log-export bodies, event frames, meters, tables
* ``functions``  - column helpers (time, text, JSON, exact sums)
* ``operators``  - joins and aggregations: validation, intervals, apportionment, impacts ...
* ``plans``      - store maintenance, rebuilds and read models composed from operators
* ``streaming``  - Structured Streaming twins of ingest and lifecycle pairing
* ``catalog``    - the named queries, each with the SQL it must agree with
"""

__version__ = "0.1.0"

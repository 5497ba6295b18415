import math

import pytest
from pyspark.sql import functions as F

from wattledger import functions as fn


def column(spark, values, expr, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [row.y for row in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_instants(spark):
    good = ["2026-07-25T14:00:00+02:00", "2026-07-25T12:00:00Z", "2026-07-25 12:00:00.1239Z", "1969-12-31T23:59:59.9995Z"]
    bad = ["", "not-a-date", "2026-07-25", "12:00:00Z", "2026-07-25T12:00:00", "2026-02-30T12:00:00Z"]
    noon = 1784980800000
    assert column(spark, good + bad, fn.parse_ms) == [noon, noon, noon + 123, 0] + [None] * len(bad)


def test_format(spark):
    assert column(spark, [0, 1794830400000], fn.format_ms, "bigint") == ["1970-01-01T00:00:00.000Z", "2026-11-16T12:00:00.000Z"]


# Fixed values of the contract.
SANITISED = {
    "": "x", "///": "x", "..": "x..", "../../../../etc/cron.d/pwned": "x........etccron.dpwned", ".hidden": "x.hidden",
    "a Z0._-": "aZ0._-", "日本語": "x", "café-01": "caf-01", "-leading-dash": "-leading-dash",
}


def test_sanitize(spark):
    once = column(spark, list(SANITISED), fn.sanitize_id)
    assert once == list(SANITISED.values())
    assert column(spark, once, fn.sanitize_id) == once


def test_day_floors(spark):
    assert column(spark, [-1, 0, 86_399_999, 86_400_000], fn.local_day, "bigint") == [-1, 0, 0, 1]


def test_exact_sum_ignores_order(spark):
    values = [0.1, 1e9, -3.3e-7, 2.7, 1e-12, 5e8] * 50
    a = spark.createDataFrame([(v,) for v in values], "v double").repartition(7).agg(fn.exact_sum("v")).first()[0]
    b = spark.createDataFrame([(v,) for v in reversed(values)], "v double").coalesce(1).agg(fn.exact_sum("v")).first()[0]
    assert a == b == pytest.approx(sum(values), rel=1e-12)
    huge = spark.createDataFrame([(1e200,), (1e200,)], "v double").agg(fn.exact_sum("v")).first()[0]
    assert huge == 2e200


def test_exact_sum_keeps_small_values(spark):
    for values in ([3.3e-19, 4e-21], [1e-30, 2e-30, 3e-30], [1e12, 1e-3], [5e20, 7e19, -2.5], [-1e-9] * 3):
        got = spark.createDataFrame([(v,) for v in values], "v double").agg(fn.exact_sum("v")).first()[0]
        assert math.isclose(got, math.fsum(values), rel_tol=1e-15)
    assert spark.createDataFrame([(None,)], "v double").agg(fn.exact_sum("v")).first()[0] is None


def test_exact_sum_of_an_overflowing_band(spark, monkeypatch):
    monkeypatch.setattr(fn, "_BAND", 60)  # wide bands overflow with few rows
    monkeypatch.setattr(fn, "_BANDS", range(2))
    rows = spark.range(2000).selectExpr("1e18D AS v").union(spark.createDataFrame([(2.0**70,)], "v double"))
    assert rows.agg(fn.exact_sum("v")).first()[0] == pytest.approx(2e21 + 2.0**70, rel=1e-12)


def test_crlf_frames(spark, folder):
    from wattledger.sources import frames

    for name, end in (("lf", "\n"), ("crlf", "\r\n")):
        with open(f"{folder}/{name}", "w", newline="") as f:
            f.write(end.join(['data: {"id":"a"}', "", ": note", 'data: {"id":', 'data: "b"}', "", ""]))
        got = frames.read_frames(spark, f"{folder}/{name}").where("v is not null").selectExpr("try_variant_get(v, '$.id', 'string') id")
        assert sorted(r.id for r in got.collect()) == ["a", "b"]


def test_stable_ids_tell_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    ids = [r[0] for r in df.select(fn.stable_id("p", "x", "y")).collect()]
    assert ids[0] == ids[2] != ids[1] and len(ids[0]) == len("p-") + 32

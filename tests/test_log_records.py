"""Log records: one reading of a body, numbers without an exchange, and only the branches that a reader asks for."""

from wattledger.operators import otlp as O

NESTED = (
    '{"resourceLogs":[null,{"scopeLogs":7},{"resource":{"attributes":[{"key":"a","value":{"stringValue":"res"}},'
    '{"key":"r","value":{"intValue":"4"}}]},"scopeLogs":[null,{"scope":{"name":"one"},"logRecords":[{},5,null]},'
    '{"logRecords":{}},{"scope":{"name":"two","attributes":[{"key":"r","value":null}]},"logRecords":[{"timeUnixNano":"7",'
    '"body":{"stringValue":"x"},"attributes":[{"key":"a","value":{"intValue":3}},{"key":5,"value":{"intValue":1}}]}]}]}]}'
)
VENDOR_A = (
    '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"1700000000000000000","body":{"stringValue":"claude_code.api_request"},'
    '"attributes":[{"key":"model","value":{"stringValue":"m"}},{"key":"input_tokens","value":{"intValue":"3"}}]}]}]}]}'
)


def _bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "arrival bigint, body string").withColumn("body_id", O.F.col("arrival"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_numbered_where_they_are_read(spark):
    records, _ = O.decode(_bodies(spark, NESTED, "{}"))
    assert "Window" not in _plan(records)
    rows = records.select(
        "index", "scope_name", "record_body", O.get_string("a").alias("a"), O.get_u64("a").alias("n"), O.get_u64("r").alias("r"), O.has("r").alias("there"),
        "own_keys",
    ).collect()
    assert sorted(tuple(r) for r in rows) == [
        (0, "one", None, "res", None, 4, True, []), (1, "one", None, "res", None, 4, True, []), (2, "one", None, "res", None, 4, True, []),
        (3, "two", "x", None, 3, None, True, ["a"]),
    ]


def test_a_reader_of_one_normaliser_reads_one_branch(spark):
    claimed = O.normalize(O.decode(_bodies(spark, VENDOR_A))[0])
    mine = claimed.where("normalizer = 'vendor_a' and outcome = 'event'").select("event.llm_call.usage.input_tokens")
    assert "Union" not in _plan(mine) and "Window" not in _plan(mine)
    assert [r[0] for r in mine.collect()] == [3]


def test_counters_read_bodies_that_are_made_once(spark):
    from wattledger import catalog

    assert "to_json" not in _plan(catalog.queries()["ot19_receiver_counters"](spark, "/root/testdata/sf0.001"))

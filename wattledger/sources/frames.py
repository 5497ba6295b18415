"""Event-stream logs (``data:`` frames separated by blank lines) and hook payload logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions import json_flag, json_text, sanitize_id
from wattledger.operators.validate import field, kind, text


def frame_data(frame: Column) -> Column:
    """``data:`` lines of a frame joined by newlines; comments and other fields are ignored."""
    unix = F.regexp_replace(frame, "\r\n", "\n")
    parts = F.regexp_extract_all(unix, F.lit(r"(?m)^data:[ ]?(.*)$"), 1)
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of an event-stream log, one row each; the last one may lack its blank line.

    Lines may end in LF or CRLF.  A log with LF is read in splits; one with CRLF has no LF LF in it, so each of its
    files is one row until it is split here.
    """
    raw = spark.read.text(path, lineSep="\n\n")
    return parse_frames(raw.select(F.explode(F.split("value", r"\r?\n\r?\n")).alias("frame")))


def parse_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    data = frames.withColumn("data", frame_data(F.col(frame))).where("data is not null")
    return data.withColumn("v", F.try_parse_json("data"))


def durable_events(frames: DataFrame) -> DataFrame:
    """Typed columns of durable-event frames, keeping the data object as VARIANT."""
    v = F.col("v")
    seq = field(v, "$.durable.seq")
    return frames.where("v is not null").withColumns(
        {
            "source_id": text(v, "$.id"),
            "event_type": F.coalesce(text(v, "$.type"), F.lit("")),
            "has_durable": F.coalesce(kind(v, "$.durable").startswith("OBJECT"), F.lit(False)),
            "aggregate_id": text(v, "$.durable.aggregateID"),
            "seq": F.when(F.schema_of_variant(seq) == "BIGINT", F.try_variant_get(v, "$.durable.seq", "bigint")),
            "event_data": field(v, "$.data"),
        }
    )


def hook_payloads(log: DataFrame, line: str = "value") -> DataFrame:
    """Hook calls as typed columns; absent and null fields read as empty text."""
    v = F.col("v")
    return (
        log.withColumn("v", F.try_parse_json(line))
        .where("v is not null")
        .withColumns(
            {
                "session_id": sanitize_id(json_text(field(v, "$.session_id"), "unknown")),
                "event": json_text(field(v, "$.hook_event_name"), ""),
                "tool_use_id": json_text(field(v, "$.tool_use_id"), ""),
                "tool_name": json_text(field(v, "$.tool_name"), ""),
                "is_interrupt": json_flag(field(v, "$.is_interrupt")),
            }
        )
    )

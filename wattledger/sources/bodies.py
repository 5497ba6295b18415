"""Log-export bodies as files: one request per file or per line, read at once or as a stream.

Rows are (body_id, arrival, origin, body, bytes).  The id is a hash of the file and the body, and for lines so is a body
that comes twice in one file the same request twice: it is delivered once.  ``arrival`` is the file's time in
milliseconds, which orders requests as exporters' landing folders do.  Bodies longer than the limit come without their
text, so that one of them cannot fill a task further on; ``quarantine`` lists them with those that do not parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the largest body that is looked at.
MAX_BODY_BYTES = 64 * 1024 * 1024
OVERSIZED = "over size"


def _bodies(lines: DataFrame, max_bytes: int) -> DataFrame:
    size = F.octet_length("value").cast("bigint")
    origin = F.col("_metadata.file_path")
    return lines.select(
        F.xxhash64(origin, "value").alias("body_id"), F.unix_millis("_metadata.file_modification_time").alias("arrival"),
        origin.alias("origin"), F.when(size <= max_bytes, F.col("value")).alias("body"), size.alias("bytes"),
    ).where("bytes > 0")


def _per(reader, per: str):
    if per not in ("file", "line"):
        raise ValueError("a body is a 'file' or a 'line'")
    return reader.format("text").option("wholetext", str(per == "file").lower()).option("recursiveFileLookup", "true")


def read_bodies(spark: SparkSession, path: str, per: str = "file", max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """The bodies under a path; empty files and lines are none."""
    return _bodies(_per(spark.read, per).load(path), max_bytes).dropDuplicates(["body_id"])


def stream_bodies(spark: SparkSession, path: str, per: str = "file", max_bytes: int = MAX_BODY_BYTES, files: int | None = None) -> DataFrame:
    """The bodies of files as they land, ``files`` of them at most in a micro-batch.

    A file is read once; repeated lines of one file are left to the store, which takes an event once.
    """
    reader = _per(spark.readStream, per)
    return _bodies((reader.option("maxFilesPerTrigger", files) if files else reader).load(path), max_bytes)


def quarantine(bodies: DataFrame, refused: DataFrame) -> DataFrame:
    """(body_id, origin, bytes, reason) of bodies that were not taken: too long to read, not JSON, or over capacity.

    ``refused`` is what decoding refused; a body without text is refused as no JSON there, and named by its length here.
    """
    why = refused.select("body_id", "reason")
    return bodies.join(why, "body_id").select(
        "body_id", "origin", "bytes", F.when(F.col("body").isNull(), OVERSIZED).otherwise(F.col("reason")).alias("reason")
    )

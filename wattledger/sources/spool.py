"""Spool files: ``<collector>.<session>.jsonl`` in one directory, one event per line."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed format: the first dot ends the collector name, both parts are non-empty.
FILE_PATTERN = r"^([^.]+)\.(.+)\.jsonl$"


def collector_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, FILE_PATTERN, 1), F.lit(""))


def session_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, FILE_PATTERN, 2), F.lit(""))


def with_origin(lines: DataFrame, name: str = "file_name") -> DataFrame:
    """Collector and session of the file name; rows of other files are left out."""
    out = lines.withColumns({"collector_file": collector_of(F.col(name)), "session_file": session_of(F.col(name))})
    return out.where(F.col("collector_file").isNotNull()).withColumn(
        "origin", F.concat_ws(":", "collector_file", "session_file")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _read(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    raw = spark.read.text(paths, lineSep="\n").select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
    )
    return with_origin(raw.where("line <> ''"))


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """Non-empty lines of the directory's own spool files; a missing directory is empty.

    The batch scan takes files as they are.  For files still being written use the tail source,
    which leaves an unfinished last line for the next read.
    """
    if not _exists(spark, directory):
        return spark.createDataFrame(
            [], "line string, file_name string, file_path string, collector_file string, session_file string, origin string"
        )
    return _read(spark, directory)


def scan_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of the named files only, under the same name grammar."""
    return _read(spark, list(paths))


def _folder(path: str):
    """The file system of a folder, and the folder's name in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        filesystem, root = fs.FileSystem.from_uri(path)
    else:
        filesystem, root = fs.LocalFileSystem(), path
    return filesystem, root.rstrip("/")


def published_sizes(path: str) -> dict[str, int]:
    """Names and sizes of the files that a writer has announced; none before its first announcement."""
    from pyarrow import fs

    filesystem, place = _folder(path)
    if filesystem.get_file_info(place).type == fs.FileType.NotFound:
        return {}
    with filesystem.open_input_stream(place) as f:
        return json.loads(f.read())


def _publish(directory: str, names: Sequence[str], path: str) -> None:
    """Announce the present sizes of some files, beside those announced before, by a file that is renamed into place."""
    filesystem, root = _folder(directory)
    sizes = {i.base_name: i.size for i in filesystem.get_file_info([f"{root}/{n}" for n in names])}
    other, place = _folder(path)
    hidden = f"{place}_{uuid.uuid4().hex}"
    with other.open_output_stream(hidden) as f:
        f.write(json.dumps(published_sizes(path) | sizes).encode())
    other.move(hidden, place)


def write_spool(lines: DataFrame, directory: str, order: str = "arrival", publish: str | None = None) -> int:
    """Write (file_name, line) rows as spool files, each whole and in ``order``; gives the number of files.

    A file is streamed by one task under a name of its own and renamed when it is complete, so a task that is tried
    again leaves the same file and no half of one.  Files become visible one by one; with ``publish`` they are announced
    in that file together when all are there, for a tail source that is told to follow it (``published``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _folder(directory)
        name, out, hidden, written = None, None, None, []

        def finish():
            if out is not None:
                out.close()
                filesystem.move(hidden, f"{root}/{name}")
                written.append(name)

        for batch in batches:
            for file_name, line in zip(batch.column("file_name").to_pylist(), batch.column("line").to_pylist()):
                if file_name != name:
                    finish()
                    name, hidden = file_name, f"{root}/_{uuid.uuid4().hex}"
                    out = filesystem.open_output_stream(hidden)
                out.write(line.encode() + b"\n")
        finish()
        if written:
            yield pa.RecordBatch.from_arrays([pa.array(written)], names=["file_name"])

    filesystem, root = _folder(directory)
    filesystem.create_dir(root, recursive=True)
    rows = lines.select("file_name", "line", F.col(order).alias("at")).where("file_name is not null and line is not null")
    dealt = rows.repartition("file_name").sortWithinPartitions("file_name", "at")
    written = dealt.mapInArrow(run, "file_name string")
    if publish is None:
        return written.count()
    names = [r.file_name for r in written.collect()]
    _publish(directory, names, publish)
    return len(names)

"""Best-fit-decreasing packing of token ids into rows of one length.

Documents longer than a row are split without loss: full rows go out at once, the rest is packed.  Rests are gathered
up to a bounded pool and placed longest first, each in the fullest row that still has room, found by a segment tree
over the rows' free room.  Each task packs what it reads, so nothing is shuffled and a lost task is done again alike.

``write`` stores packed rows as flat matrices that a trainer can map into memory, and ``read`` gives the rows back:

    ids/part-00000.u32        rows x length little-endian unsigned 32-bit ids
    positions/part-00000.u32  the same of positions
    segments/                 Parquet: part, row, cu_seqlens, doc_ids, starts
    manifest/                 Parquet: part, rows, filled (places that hold ids); written last, so it tells a whole folder
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.session import cut
from wattledger.sources.spool import _folder

#: Ids that a pool of rests holds before it is packed.
POOL = 1 << 21
#: Rows of a matrix that are read in one go.
ROWS = 1024


class Rooms:
    """Rows by their free room: a tree over rooms 0 to ``length`` whose nodes count the rows below."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, and that room; it leaves the tree."""
        k = need + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        while k:
            self.count[k] -= 1
            k >>= 1
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers: longest items first, ties as they come, each in the fullest row with room for it."""
    rooms, rows = Rooms(length), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[item])
        if found is None:
            found = (len(rows), length)
            rows.append([])
        row, room = found
        rows[row].append(item)
        if room > lengths[item]:
            rooms.add(room - lengths[item], row)
    return rows


def pack(df: DataFrame, length: int = 2048, end: int = 50256, key: str = "doc_id", ids: str = "ids", pool: int = POOL) -> DataFrame:
    """Packed rows of (key, ids), ids being binary little-endian unsigned 32-bit.

    Each document is its ids and then ``end``; a null or empty one is the end alone.  Columns of a row: part, row (its
    number in the part), ids and positions (binary, ``length`` unsigned 32-bit integers each; unused places hold
    ``end`` and position 0), cu_seqlens (0 and the end of each segment), doc_ids and starts (document of each segment
    and the place in it where the segment begins).  Positions begin at 0 in each segment.  Repeated or null keys stay
    documents of their own.
    """
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("positions", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.LongType())),
    ])
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    count = np.arange(length, dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        rests: list[tuple[int, int, np.ndarray]] = []
        held, out = 0, []

        def put(segments: list[tuple[int, int, np.ndarray]]) -> None:
            nonlocal row
            sizes = [len(s[2]) for s in segments]
            used = sum(sizes)
            whole = np.full(length, end, "<u4")
            whole[:used] = np.concatenate([s[2] for s in segments])
            places = np.zeros(length, "<u4")
            places[:used] = np.concatenate([count[:n] for n in sizes])
            out.append((part, row, whole.tobytes(), places.tobytes(), [0, *np.cumsum(sizes).tolist()],
                        [s[0] for s in segments], [s[1] for s in segments]))
            row += 1

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) >= least and out:
                some = out[:512]
                del out[:512]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=schema.names)

        def place() -> None:
            nonlocal held
            for items in best_fit([len(r[2]) for r in rests], length):
                put([rests[i] for i in items])
            rests.clear()
            held = 0

        for batch in batches:
            for who, raw in zip(batch.column(key).to_pylist(), batch.column(ids)):
                tokens = np.append(np.frombuffer(raw.as_py() or b"", "<u4"), np.uint32(end))
                for start in range(0, len(tokens), length):
                    piece = tokens[start : start + length]
                    if len(piece) == length:
                        put([(who, start, piece)])
                    else:
                        rests.append((who, start, piece))
                        held += len(piece)
                    yield from flush(512)
                if held >= pool:
                    place()
        place()
        yield from flush(1)

    return df.select(key, ids).mapInArrow(run, schema)


def fill(packed: DataFrame, length: int = 2048) -> DataFrame:
    """One row: rows, filled (places that hold ids) and fill, their share of all places; null without rows."""
    filled = F.sum(F.try_element_at("cu_seqlens", F.lit(-1)).cast("bigint"))
    return packed.agg(F.count("*").alias("rows"), F.coalesce(filled, F.lit(0)).alias("filled")).withColumn(
        "fill", F.try_divide("filled", F.col("rows") * length)
    )


def write(packed: DataFrame, directory: str) -> DataFrame:
    """Write rows of ``pack`` as matrices, one of ids and one of positions for each part; gives the manifest.

    A matrix is streamed by one task under a name of its own and renamed when it is whole, so a task that is tried again
    leaves the same files.  Matrices and segments come from one written copy of the rows.  No rows make an empty manifest.
    """
    spark, rows = packed.sparkSession, cut(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _folder(directory)
        kinds, part, number, filled, outs, done = ("ids", "positions"), None, 0, 0, {}, []

        def finish() -> None:
            for kind, (hidden, out) in outs.items():
                out.close()
                filesystem.move(hidden, f"{root}/{kind}/part-{part:05d}.u32")
            if part is not None:
                done.append((part, number, filled))

        for batch in batches:
            ends = batch.column("cu_seqlens").to_pylist()
            for k, here in enumerate(batch.column("part").to_pylist()):
                if here != part:
                    finish()
                    part, number, filled, outs = here, 0, 0, {}
                    for kind in kinds:
                        hidden = f"{root}/{kind}/_{uuid.uuid4().hex}"
                        outs[kind] = (hidden, filesystem.open_output_stream(hidden))
                for kind, (_, out) in outs.items():
                    out.write(batch.column(kind)[k].as_py())
                number, filled = number + 1, filled + ends[k][-1]
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.int64(), pa.int64()))],
                                             names=["part", "rows", "filled"])

    filesystem, root = _folder(directory)
    for kind in ("ids", "positions"):
        filesystem.create_dir(f"{root}/{kind}", recursive=True)
    dealt = rows.select("part", "row", "ids", "positions", "cu_seqlens").repartition("part").sortWithinPartitions("part", "row")
    manifest = cut(dealt.mapInArrow(run, "part int, rows bigint, filled bigint"))
    rows.select("part", "row", "cu_seqlens", "doc_ids", "starts").write.mode("overwrite").parquet(f"{directory}/segments")
    manifest.write.mode("overwrite").parquet(f"{directory}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{directory}/manifest")


def read(spark: SparkSession, directory: str, length: int = 2048) -> DataFrame:
    """The rows that ``write`` stored, read in ranges of rows, so a large matrix is many tasks."""
    manifest = spark.read.schema("part int, rows bigint, filled bigint").parquet(f"{directory}/manifest")
    ranges = manifest.select("part", "rows", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.lit(ROWS).cast("bigint"))).alias("first"))
    wide = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _folder(directory)
        for batch in batches:
            for part, rows, first in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "first"))):
                n, found = min(ROWS, rows - first), []
                for kind in ("ids", "positions"):
                    with filesystem.open_input_file(f"{root}/{kind}/part-{part:05d}.u32") as f:
                        if f.size() != rows * wide:
                            raise ValueError(f"{kind} of part {part}: {f.size()} bytes are not {rows} rows of {length}")
                        f.seek(first * wide)
                        data = f.read(n * wide)
                    found.append(pa.array([data[at : at + wide] for at in range(0, n * wide, wide)], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), *found], names=["part", "row", "ids", "positions"]
                )

    matrices = ranges.repartition("part", "first").mapInArrow(run, "part int, row bigint, ids binary, positions binary")
    segments = spark.read.schema("part int, row bigint, cu_seqlens array<int>, doc_ids array<bigint>, starts array<bigint>").parquet(f"{directory}/segments")
    return matrices.join(segments, ["part", "row"])

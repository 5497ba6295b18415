"""First-fit lanes for overlapping intervals, placed slice by slice on many tasks.

The lane of an interval depends on all earlier intervals of its key.  Rows are range-partitioned by key and start, so a
slice is one range and a large key has many.  Every slice is placed as if all lanes were free at its start; then the lane
ends that a key leaves behind in one slice are handed to its next one, and only slices that begin with other ends than
they were placed with are placed again, until none is.  An end that lies before a slice's first start is forgotten, so a
moment with free lanes stops the handing on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.session import cut

#: Columns added to the rows: their slice, and in a slice's heading row the lane ends its first key begins with.
_SLICE, _ENDS = "__slice", "__ends"


def _walk(batches: Iterator[pa.RecordBatch], keys: Sequence[str], start: str, end: str, tracks: int):
    """(batch, lane of each row, finished groups) over rows sorted by slice, key and start.

    A finished group is (slice, key, first start, lane ends), of the first and the last key of each slice.
    """
    group, ends, opened, heads, heading = None, [], None, False, None
    for batch in batches:
        lanes, done = [], []
        columns = [batch.column(c).to_pylist() for c in (_SLICE, *keys)]
        for here, s, e, given in zip(zip(*columns), *(batch.column(c).to_pylist() for c in (start, end, _ENDS))):
            if given is not None:
                heading = (here, given)
                lanes.append(None)
                continue
            if here != group:
                slice_changes = group is None or group[0] != here[0]
                if group is not None and (heads or slice_changes):
                    done.append((*group, opened, ends))
                ends = list(heading[1]) if heading is not None and heading[0] == here else [None] * tracks
                group, opened, heads = here, s, slice_changes
            free = next((i for i, busy in enumerate(ends) if busy is None or busy <= s), None)
            if free is not None:
                ends[free] = s if e is None else e
            lanes.append(free)
        yield batch, lanes, done
    if group is not None:
        yield None, [], [(*group, opened, ends)]


def _with_headings(rows: DataFrame, carried: DataFrame | None, keys: Sequence[str], start: str, item: str) -> DataFrame:
    """Slices in order, each with the heading row of what its first key begins with."""
    whole = rows.withColumn(_ENDS, F.lit(None).cast("array<bigint>"))
    if carried is not None:
        whole = whole.unionByName(carried.select(_SLICE, *keys, _ENDS), allowMissingColumns=True)
    return whole.repartition(_SLICE).sortWithinPartitions(_SLICE, *keys, F.col(_ENDS).isNull(), start, item)


def _left_behind(rows: DataFrame, carried: DataFrame | None, keys: Sequence[str], start: str, end: str, item: str, tracks: int) -> DataFrame:
    """Lane ends of the first and the last key of each slice."""
    used = rows.select(_SLICE, *keys, start, end, item)
    kinds = T.StructType([
        T.StructField(_SLICE, T.IntegerType()), *(T.StructField(k, rows.schema[k].dataType) for k in keys),
        T.StructField("opened", rows.schema[start].dataType), T.StructField(_ENDS, T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, done in _walk(batches, keys, start, end, tracks):
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, d)) for d in done], schema=_arrow(kinds))

    return _with_headings(used, carried, keys, start, item).mapInArrow(run, kinds)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _handed_on(left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each slice's first key begins with: the ends it left in its slice before, those in the past forgotten."""
    before = F.lag(_ENDS).over(Window.partitionBy(*keys).orderBy(_SLICE))
    ends = F.transform("given", lambda e: F.when(e > F.col("opened"), e))
    return left.withColumn("given", before).where("given is not null").select(_SLICE, *keys, ends.alias(_ENDS)).where(
        F.exists(_ENDS, lambda e: e.isNotNull())
    )


def assign(df: DataFrame, keys: Sequence[str], start: str, end: str, item: str, tracks: int, slices: int | None = None) -> DataFrame:
    """``track`` of each interval: the lowest lane free at its start, null when none is.

    Ties in start go by ``item``.  Rows without a start are left out, one without an end frees its lane at once, repeated
    rows take a lane each, and null keys are one key.  ``slices`` sets the number of ranges (by default the session's, as
    sizes ask).  There are as many rounds as slices that an occupied lane is felt over, and each places only the slices
    that begin differently from the round before.
    """
    keys = list(keys)
    ranges = [*keys, start, item]
    dealt = df.where(F.col(start).isNotNull())
    dealt = dealt.repartitionByRange(slices, *ranges) if slices else dealt.repartitionByRange(*ranges)
    rows = cut(dealt.withColumn(_SLICE, F.spark_partition_id()))
    carried, left = None, cut(_left_behind(rows, None, keys, start, end, item, tracks))
    while True:
        given = cut(_handed_on(left, keys))
        if carried is None:
            changed = given.select(_SLICE)
        else:
            was = carried.select(_SLICE, F.col(_ENDS).alias("was"), F.lit(True).alias("known"))
            now = given.select(_SLICE, _ENDS, F.lit(True).alias("given"))
            changed = was.join(now, _SLICE, "full").where(~F.col("was").eqNullSafe(F.col(_ENDS)) | F.col("known").isNull() | F.col("given").isNull()).select(_SLICE)
        changed = cut(changed)
        carried = given
        if changed.isEmpty():
            break
        again = _left_behind(rows.join(changed, _SLICE, "left_semi"), given.join(changed, _SLICE, "left_semi"), keys, start, end, item, tracks)
        left = cut(left.join(changed, _SLICE, "left_anti").unionByName(again))
    schema = T.StructType([*df.schema.fields, T.StructField("track", T.IntegerType())])
    names = df.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lanes, _ in _walk(batches, keys, start, end, tracks):
            if batch is not None:
                whole = batch.select(names).append_column("track", pa.array(lanes, pa.int32()))
                yield whole.filter(batch.column(_ENDS).is_null())

    return _with_headings(rows, carried, keys, start, item).mapInArrow(place, schema)

"""As-of and running computations over ordered logs, without whole-key windows.

A plain window over a key sorts all of that key in one task, and one key may hold a third of the
log.  Here a log is cut into blocks of its order column: windows run inside (key, block), each block
is reduced to one row, a second window runs over those, and its result is handed back to the rows.
The order column must be an integer (arrival number, epoch milliseconds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000


def _running(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int, kind: str, forward: bool
) -> DataFrame:
    keys = list(keys)
    blk = "__block"
    df = df.withColumn(blk, F.floor(F.col(order) / F.lit(block)).cast("bigint")).withColumn("__value", value)
    sort = F.col(order) if forward else F.col(order).desc()
    sort_block = F.col(blk) if forward else F.col(blk).desc()
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*keys, blk).orderBy(sort).rowsBetween(*before)
    if kind == "max":
        agg = lambda c: F.max(c)
        whole = F.max("__value")
        merge = lambda a, b: F.greatest(a, b)
    else:
        agg = lambda c: F.last(c, ignorenulls=True)
        newest = F.when(F.col("__value").isNotNull(), F.col(order) if forward else -F.col(order))
        whole = F.max_by("__value", newest)
        merge = lambda a, b: F.coalesce(a, b)
    rows = df.withColumn("__inside", agg("__value").over(inside))
    blocks = df.groupBy(*keys, blk).agg(whole.alias("__whole"))
    carried = blocks.withColumn(
        "__carried", agg("__whole").over(Window.partitionBy(*keys).orderBy(sort_block).rowsBetween(*before))
    ).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(blk).alias("__b"), "__carried")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col(blk) == F.col("__b")]
    joined = rows.join(carried.where("__carried is not null"), on, "left")
    return joined.withColumn(out, merge(F.col("__inside"), F.col("__carried"))).drop(
        blk, "__b", "__value", "__inside", "__carried", *[f"__k{i}" for i in range(len(keys))]
    )


def last_before(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Latest non-null ``value`` of earlier rows of the key."""
    return _running(df, keys, order, value, out, block, "last", True)


def next_after(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """First non-null ``value`` of later rows of the key."""
    return _running(df, keys, order, value, out, block, "last", False)


def max_before(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Largest ``value`` of earlier rows of the key."""
    return _running(df, keys, order, value, out, block, "max", True)

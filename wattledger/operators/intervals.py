"""Interval joins, merged windows and coverage.

Spark has no interval join: a raw overlap predicate becomes a nested-loop join.  Here both sides
are cut into time cells and joined by equality on (keys, level, cell), then the exact predicate is
applied.

Interval lengths vary from milliseconds to months, so one cell width is either too fine (a long
interval explodes into millions of cells) or too coarse.  Each interval therefore belongs to the
finest *level* at which it spans at most ``SPREAD`` cells, and two intervals meet at the coarser
of their two levels.  A row is emitted at its own level plus the coarser levels the other side
really uses, so the fan-out is bounded whatever the lengths are, and a busy key is still divided
over its time cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cell widths of the levels, 16x apart: 15 s, 4 min, 64 min, 17 h, 11 d, 182 d, 8 y, everything.
LEVEL_MS = tuple(15_000 * 16**i for i in range(7)) + (2**62,)
SPREAD = 8

_LEVEL, _CELL, _FIRST, _OWN = "__level", "__cell", "__first", "__own"


def _own_level(start: str, end: str) -> Column:
    arms = " ".join(f"WHEN {end} - {start} <= {SPREAD * w} THEN {i}" for i, w in enumerate(LEVEL_MS[:-1]))
    return F.expr(f"CASE {arms} ELSE {len(LEVEL_MS) - 1} END")


def _cell_of(instant: str) -> Column:
    arms = " ".join(f"WHEN {i} THEN floor({instant} / {w})" for i, w in enumerate(LEVEL_MS[:-1]))
    return F.expr(f"CAST(CASE {_LEVEL} {arms} ELSE 0 END AS BIGINT)")


def _levels_used(df: DataFrame, bounds: tuple[str, str]) -> Column:
    """The levels present in a side, as a one-row subquery (at most ``len(LEVEL_MS)`` values)."""
    level = _own_level(*bounds)
    return df.select(level.alias("l")).agg(F.collect_set("l").alias("ls")).scalar()


def _to_cells(df: DataFrame, bounds: tuple[str, str], levels: Column, prefix: str) -> DataFrame:
    start, end = F.col(bounds[0]), F.col(bounds[1])
    own = f"{prefix}{_OWN}"
    # Meet the other side at its coarser levels, and at the own one when it has something as fine
    # or finer: those rows come up to meet this one.
    used = "__used"
    out = df.where(start.isNotNull() & end.isNotNull()).withColumns({own: _own_level(*bounds), used: levels})
    out = out.withColumn(_LEVEL, F.explode(F.array_union(F.col(used), F.array(F.col(own)))))
    meets = (F.col(_LEVEL) > F.col(own)) | ((F.col(_LEVEL) == F.col(own)) & (F.array_min(used) <= F.col(own)))
    out = out.where(meets).drop(used)
    # Zero-length and inverted intervals sit in the cell of their start.
    first, last = _cell_of(bounds[0]), _cell_of(f"greatest({bounds[1]} - 1, {bounds[0]})")
    return out.select("*", first.alias(f"{prefix}{_FIRST}"), F.explode(F.sequence(first, last)).alias(_CELL))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
) -> DataFrame:
    """Every pair of equal ``keys`` with ``left.start < right.end and left.end > right.start``.

    Bounds are half-open epoch milliseconds.  Columns other than the keys must have distinct
    names.
    """
    keys = list(keys)
    left_levels, right_levels = _levels_used(left, left_bounds), _levels_used(right, right_bounds)
    a = _to_cells(left, left_bounds, right_levels, "a")
    b = _to_cells(right, right_bounds, left_levels, "b")
    (ls, le), (rs, re) = left_bounds, right_bounds
    joined = a.join(b, keys + [_LEVEL, _CELL])
    # A pair meets only at the coarser own level and, of the cells both touch, only in the first.
    once = (F.col(_LEVEL) == F.greatest(f"a{_OWN}", f"b{_OWN}")) & (
        F.col(_CELL) == F.greatest(f"a{_FIRST}", f"b{_FIRST}")
    )
    overlap = (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
    return joined.where(once & overlap).drop(
        _LEVEL, _CELL, f"a{_OWN}", f"b{_OWN}", f"a{_FIRST}", f"b{_FIRST}"
    )


# ---------------------------------------------------------------- merged windows

# Windows are merged inside time slices first; a merged piece that reaches no slice border is final.
SLICE_MS = 6 * 3_600_000


def _slices(df: DataFrame, keys: Sequence[str], start: str, end: str, slice_ms: int) -> DataFrame:
    """Cut positive-length windows at slice borders."""
    width = F.lit(slice_ms)
    s, e = F.col(start), F.col(end)
    cut = df.where(e > s).select(
        *keys,
        s.alias("s"),
        e.alias("e"),
        F.explode(
            F.sequence(F.floor(s / width).cast("bigint"), F.floor((e - 1) / width).cast("bigint"))
        ).alias("slice"),
    )
    return cut.select(
        *keys,
        "slice",
        F.greatest("s", F.col("slice") * slice_ms).alias("s"),
        F.least("e", (F.col("slice") + 1) * slice_ms).alias("e"),
    )


def _merge_touching(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps and islands over ``s``/``e`` inside each key."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("opens", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    numbered = flagged.withColumn("island", F.sum("opens").over(order))
    return numbered.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def sliced_islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Merged windows clipped to time slices: additive, and no task holds more than a slice of a key."""
    distinct = _slices(df, keys, start, end, slice_ms).distinct()
    return _merge_touching(distinct, [*keys, "slice"])


def merge_islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Union of positive-length windows per key; touching windows are one island.

    The second pass looks only at pieces that reach a slice border, two per slice at most, so its
    group size is bounded by elapsed time and not by the number of rows.
    """
    keys = list(keys)
    pieces = sliced_islands(df, keys, start, end, slice_ms)
    at_border = (F.pmod(F.col("s"), F.lit(slice_ms)) == 0) | (F.pmod(F.col("e"), F.lit(slice_ms)) == 0)
    inner = pieces.where(~at_border).select(*keys, "s", "e")
    stitched = _merge_touching(pieces.where(at_border).select(*keys, "s", "e"), keys)
    out = inner.unionByName(stitched)
    return out.select(*keys, F.col("s").alias(start), F.col("e").alias(end))


def coverage_fraction(
    units: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    unit_id: str,
    unit_bounds: tuple[str, str],
    window_bounds: tuple[str, str],
) -> DataFrame:
    """Share of each unit's extent covered by the union of windows, in 0..1 (0 for empty extents).

    Clipped pieces are disjoint, so their overlaps simply add up and no global merge is needed.
    """
    from wattledger.functions import clamp, overlap_ms

    keys = list(keys)
    u0, u1 = unit_bounds
    pieces = sliced_islands(windows, keys, *window_bounds).select(
        *keys, F.col("s").alias("__w0"), F.col("e").alias("__w1")
    )
    hits = overlap_join(
        units.where(F.col(u1) > F.col(u0)).select(*keys, unit_id, u0, u1), pieces, keys, (u0, u1), ("__w0", "__w1")
    )
    covered = hits.groupBy(unit_id).agg(F.sum(overlap_ms(u0, u1, "__w0", "__w1")).alias("__covered_ms"))
    length = F.col(u1) - F.col(u0)
    return (
        units.join(covered, unit_id, "left")
        .withColumn(
            "coverage",
            F.when(
                length > 0, clamp(F.coalesce("__covered_ms", F.lit(0)) / length, 0.0, 1.0)
            ).otherwise(F.lit(0.0)),
        )
        .drop("__covered_ms")
    )


def coverage_gaps(islands: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The holes between consecutive islands of a key."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return (
        islands.withColumn("__next", following)
        .where(F.col("__next").isNotNull())
        .select(*keys, F.col(end).alias("gap_start"), F.col("__next").alias("gap_end"))
    )


def assign_tracks(
    df: DataFrame, keys: Sequence[str], start: str, end: str, item: str, tracks: int = 7, slices: int | None = None
) -> DataFrame:
    """First-fit lane per interval in start order; ``track`` is null when every lane is busy (``operators.tracks``)."""
    from wattledger.operators import tracks as placement

    return placement.assign(df, list(keys), start, end, item, tracks, slices)

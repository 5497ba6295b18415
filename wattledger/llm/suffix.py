"""Exact removal of repeated byte strings with a sparse suffix array.

A byte goes if it is covered by a ``window``-byte string that also starts earlier: in a document with a smaller id, or
before it in the same one.

1. Every window is represented by an anchor: the place in it whose ``gram`` bytes have the smallest hash.  Equal
   windows have their anchor at the same place, so only suffixes that start at anchors need sorting, one for about 40
   bytes.  Anchors whose gram occurs once in the corpus cannot be repeats and are left out.
2. Each remaining suffix carries the bytes that its windows cover.  Sampled splitters range-partition the suffixes by
   their bytes and then their place, so suffixes of one passage, however many, are spread over as many buckets as it
   takes.  Each bucket is sorted.
3. Equal neighbours are folded as a bucket streams by: all but the first go.  For the different ones under equal leading
   bytes a multikey quicksort and the common prefixes of neighbours, to the right and to the left of the anchor, give
   for each window the class of equal windows; all but the first of a class go.
4. The groups at a bucket's two ends may go on in the buckets beside it: they are handed out and compared across the
   borders.  A group of more than ``frequent`` different suffixes is split by further leading bytes: its suffixes are
   divided into runs of fewer windows, whose leading bytes are all that these windows share, and sorted into buckets
   again, down to single windows, of which only equal ones share their leading bytes.

The documents' order is an integer, ``ref``; texts that occur again as a whole are removed as a whole and take no part
in the sorting.  Texts are dealt out by ``ref`` once, compressed, and that exchange serves all three steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import map_batches, pack, unpacked
from wattledger.session import cut

WINDOW = 100
GRAM = 20
#: Window starts that are looked at in one go.
PIECE = 1 << 20
#: Different suffixes under equal leading bytes that are compared in one go, at most.
FREQUENT = 5_000
#: Larger groups are divided into runs of so many windows, and so on.
STEPS = (16, 4, 1)
#: Suffixes of small groups that a bucket compares in one go, about.
CHUNK = 20_000
#: Rows that the quicksort hands to a plain sort.
SMALL = 48

#: An anchor's place in its document: start of its first window, number of windows, distance to the anchor.
_N, _OFF = 1 << 7, 1 << 14


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place."""
    base, mask = 0x100000001B3, (1 << 64) - 1
    done, size, part, width, left = None, 0, data.astype(np.uint64) + np.uint64(1), 1, gram
    while left:
        if left & 1:
            if done is None:
                done, size = part, width
            else:
                n = min(len(done), len(part) - size)
                done = done[:n] * np.uint64(pow(base, width, mask + 1)) + part[size : size + n]
                size += width
        left >>= 1
        if left:
            part = part[:-width] * np.uint64(pow(base, width, mask + 1)) + part[width:]
            width *= 2
    done = done * np.uint64(0x9E3779B97F4A7C15)
    done ^= done >> np.uint64(29)
    done *= np.uint64(0xBF58476D1CE4E5B9)
    done ^= done >> np.uint64(32)
    return done


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, first window, windows, distance) of each anchor of bytes no longer than a piece."""
    if len(data) < window:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    hashes = _grams(data, gram)
    # The high bits of the hash and then the place: of equal grams the leftmost is the smallest.
    bits = np.uint64(24)
    low = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    at = place[first]
    return hashes[at].view(np.int64), first, np.diff(np.append(first, len(place))), at - first


def _joined(texts: list[bytes], window: int, piece: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together up to a piece, long ones cut so that each window is in one part.

    Gives the bytes, and for each part its text's number, its start in the text and its start in the bytes.
    """
    out, who, start, at, size = [], [], [], [], 0
    for k, text in enumerate(texts):
        for s in range(0, max(1, len(text) - window + 1), piece):
            part = text[s : s + piece + window - 1]
            if len(part) < window:
                continue
            if size and size + len(part) > piece:
                yield b"".join(out), *(np.array(x, np.int64) for x in (who, start, at))
                out, who, start, at, size = [], [], [], [], 0
            out.append(part)
            who.append(k)
            start.append(s)
            at.append(size)
            size += len(part)
    if out:
        yield b"".join(out), *(np.array(x, np.int64) for x in (who, start, at))


def _anchored(texts: list[bytes], window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, text's number, first window, windows, distance) of every anchor, several texts at a time."""
    for data, who, start, at in _joined(texts, window, PIECE):
        raw = np.frombuffer(data, np.uint8)
        h, first, n, off = anchors(raw, window, gram)
        # Windows over the border of two parts do not count.  A run of windows is shorter than a part, so it
        # crosses one border at most: what lies before it and what lies after it are runs of their own.
        part = np.searchsorted(at, first, "right") - 1
        end = np.append(at[1:], len(raw))[part]
        stop = first + n
        before, after = np.minimum(stop, end - window + 1) - first, stop - end
        for ok, f, m, p in ((before > 0, first, before, part), (after > 0, end, after, part + 1)):
            f, m, p = f[ok], m[ok], p[ok]
            yield h[ok], who[p], f - at[p] + start[p], m, (first + off)[ok] - f


def find_anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h, ref, place) of every anchor of (ref, z)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        refs = batch.column("ref").to_numpy()
        got = [
            (h, refs[who], (s0 * _N + n) * _N + off)
            for h, who, s0, n, off in _anchored(unpacked(batch), window, gram)
        ]
        if not got:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([g[i] for g in got])) for i in range(3)], names=["h", "ref", "place"]
        )

    return map_batches(docs, run, "h bigint, ref bigint, place bigint")


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place // _OFF, place // _N % _N, place % _N


def _suffixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(lead, off, body, ref, s0) of each suffix of (ref, z, places): its leading bytes and what its windows cover."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lead, off_, body, ref_, s0_ = [], [], [], [], []
        texts = unpacked(batch)
        refs = batch.column("ref").to_pylist()
        packed = batch.column("places")
        for k, text in enumerate(texts):
            for s0, n, off in zip(*(x.tolist() for x in _unpack(packed[k].values.to_numpy()))):
                lead.append(text[s0 + off : s0 + off + gram])
                off_.append(off)
                body.append(text[s0 : s0 + n - 1 + window])
                ref_.append(refs[k])
                s0_.append(s0)
        if not lead:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(lead, pa.binary()), pa.array(off_, pa.int32()), pa.array(body, pa.binary()),
             pa.array(ref_, pa.int64()), pa.array(s0_, pa.int64())],
            names=["lead", "off", "body", "ref", "s0"],
        )

    return map_batches(docs, run, "lead binary, off int, body binary, ref bigint, s0 bigint")


def _order(rows: np.ndarray) -> np.ndarray:
    """Multikey quicksort of equally long byte rows, by words of 8 bytes.

    The rows of a part are divided at a pivot into those with a smaller, the same and a larger word; those with the
    same one go on with the next word.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order, open_ = np.arange(n), [(0, n, 0)]
    while open_:
        start, stop, d = open_.pop()
        if stop - start < 2 or d == words.shape[1]:
            continue
        here = order[start:stop]
        if stop - start <= SMALL:
            order[start:stop] = here[np.lexsort(words[here, d:].T[::-1])]
            continue
        key = words[here, d]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[start:stop] = np.concatenate((here[less], here[same], here[more]))
        low, high = start + int(less.sum()), stop - int(more.sum())
        open_ += [(start, low, d), (low, high, d + 1), (high, stop, d)]
    return order


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; the first has 0."""
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate(([0], same))


def repeats(lead: np.ndarray, off: np.ndarray, n: np.ndarray, body: list[bytes], rank: np.ndarray,
            window: int = WINDOW) -> np.ndarray:
    """For each suffix (row) and number of bytes left of its anchor (column): whether that window starts earlier too.

    ``lead`` numbers the leading bytes; ``rank`` orders the suffixes as they stand in the corpus.
    """
    size = len(body)
    most = int(off.max()) + 1
    right, left = np.zeros((size, window), np.uint8), np.zeros((size, most), np.uint8)
    for k, (b, o) in enumerate(zip(body, off.tolist())):
        part = np.frombuffer(b, np.uint8)
        r = part[o : o + window]
        right[k, : len(r)] = r
        left[k, :o] = part[:o][::-1]

    def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = _order(rows)
        return order, _common(rows[order])

    r_order, r_common = classes(right)
    l_order, l_common = classes(left)
    r_class, l_class = np.empty(size, np.int64), np.empty(size, np.int64)
    gone = np.zeros((size, most), bool)
    for k in range(most):  # bytes left of the anchor
        has = np.flatnonzero((off >= k) & (off - n < k))
        if len(has) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < window - k)
        l_class[l_order] = np.cumsum(l_common < k) if k else 0
        key = r_class[has] * (size + 1) + l_class[has]
        order = np.lexsort((rank[has], lead[has], key))
        key, head, who = key[order], lead[has][order], has[order]
        again = np.concatenate(([False], (key[1:] == key[:-1]) & (head[1:] == head[:-1])))
        gone[who[again], k] = True
    return gone


def _judged(held: list[tuple], window: int) -> tuple[np.ndarray, ...] | None:
    """(ref, start, end) to remove among different suffixes (lead, off, body, ref, s0) under whole leads."""
    lead_ids: dict[bytes, int] = {}
    lead = np.array([lead_ids.setdefault(x[0], len(lead_ids)) for x in held], np.int64)
    keep = np.flatnonzero(np.bincount(lead, minlength=1)[lead] > 1)
    if len(keep) < 2:
        return None
    held, lead = [held[k] for k in keep.tolist()], lead[keep]
    off = np.array([x[1] for x in held])
    n = np.array([len(x[2]) - window + 1 for x in held])
    ref, s0 = np.array([x[3] for x in held], np.int64), np.array([x[4] for x in held], np.int64)
    rank = np.empty(len(held), np.int64)
    rank[np.lexsort((s0 + off, ref))] = np.arange(len(held))
    gone = repeats(lead, off, n, [x[2] for x in held], rank, window)
    # From few bytes left of the anchor to many is from late to early starts.
    flat = np.pad(gone[:, ::-1].astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(flat, axis=1)
    row, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    shift = s0[row] + off[row] - (gone.shape[1] - 1)
    return ref[row], shift + begin, shift + end - 1 + window


_SUFFIX = ("lead", "off", "body", "ref", "s0")
#: What a bucket puts out: bytes to remove, suffixes of the groups at its ends, suffixes of groups that are too large.
_CUT, _BORDER, _LARGE = 0, 1, 2
_BUCKET = "kind int, lead binary, off int, body binary, ref bigint, s0 bigint, end bigint"


def _bucketed(suffixes: DataFrame, window: int, frequent: int, chunk: int) -> DataFrame:
    """Rows of _BUCKET from sorted buckets of suffixes; a cut has its start in s0."""
    arrow = pa.schema([
        ("kind", pa.int32()), ("lead", pa.binary()), ("off", pa.int32()), ("body", pa.binary()), ("ref", pa.int64()),
        ("s0", pa.int64()), ("end", pa.int64()),
    ])

    def cuts(ref, start, end) -> pa.RecordBatch:
        n = len(ref)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, _CUT, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            pa.array(ref, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
        ], schema=arrow)

    def passed(kind: int, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(x, t.type) for x, t in zip(zip(*rows), list(arrow)[1:6])),
            pa.nulls(len(rows), pa.int64()),
        ], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # small groups that lie inside the bucket
        group: list[tuple] = []  # the group that streams by
        last, first, at_start, large = None, None, True, False

        def judge() -> Iterator[pa.RecordBatch]:
            found = _judged(held, window) if len(held) > 1 else None
            if found is not None and len(found[0]):
                yield cuts(*found)
            held.clear()

        for batch in batches:
            folded: list[tuple[int, int, int]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in _SUFFIX)):
                if last is not None and row[:3] == last:
                    if row[3:] != first:  # else a repeated row of the table
                        folded.append((row[3], row[4], row[4] + len(row[2])))
                    continue
                if last is not None and row[0] != last[0]:
                    if large:
                        if group:
                            yield passed(_LARGE, group)
                    elif at_start:
                        yield passed(_BORDER, group)
                    else:
                        held += group
                    if len(held) >= chunk:
                        yield from judge()
                    group, large, at_start = [], False, False
                elif len(group) >= frequent:
                    yield passed(_LARGE, group)
                    group, large = [], True
                last, first = row[:3], row[3:]
                group.append(row)
            if folded:
                yield cuts(*zip(*folded))
        if group:
            yield passed(_LARGE if large else _BORDER, group)
        yield from judge()

    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = suffixes.repartitionByRange(parts, *_SUFFIX).sortWithinPartitions(*_SUFFIX)
    return buckets.mapInArrow(run, _BUCKET)


def _over_borders(border: DataFrame, window: int) -> DataFrame:
    """(ref, start, end) to remove among the groups that lie at the ends of buckets."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(set(zip(*(table.column(c).to_pylist() for c in _SUFFIX))))
        found = _judged(rows, window) or ((), (), ())
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("ref", "start", "end"), found)})

    return border.groupBy("lead").applyInArrow(run, "ref bigint, start bigint, end bigint")


def _divided(rows: DataFrame, wide: int, window: int) -> DataFrame:
    """The suffixes as runs of up to ``wide`` windows each, led by the bytes that all windows of such a run share."""
    least = F.expr(f"off - octet_length(body) + {window}")  # bytes left of the anchor in the last window
    return (
        rows.withColumn("least", least)
        .withColumn("part", F.explode(F.expr(f"sequence(least div {wide}, off div {wide})")))
        .withColumn("low", F.expr(f"greatest(least, part * {wide})"))
        .withColumn("high", F.expr(f"least(off, part * {wide} + {wide - 1})"))
        .select(
            "part", F.col("high").cast("int").alias("off"),
            F.expr(f"substring(body, int(off - high + 1), int(high - low + {window}))").alias("body"),
            "ref", F.expr("s0 + off - high").alias("s0"),
        )
        .select(
            F.concat(F.unhex(F.lpad(F.hex("part"), 2, "0")), F.expr(f"substring(body, int(off - part * {wide} + 1), {window - wide + 1})")).alias("lead"),
            "off", "body", "ref", "s0",
        )
    )


def _cuts(suffixes: DataFrame, window: int, frequent: int, chunk: int) -> DataFrame:
    """(ref, start, end) of runs of bytes to remove."""
    done = []
    for wide in (*STEPS, None):
        level = cut(_bucketed(suffixes, window, frequent, chunk))
        done.append(level.filter(f"kind = {_CUT}").select("ref", F.col("s0").alias("start"), "end"))
        border = level.filter(f"kind = {_BORDER}").select(*_SUFFIX)
        large = level.filter(f"kind = {_LARGE}").select(*_SUFFIX)
        if wide is None:
            done.append(_over_borders(border, window))
            break
        # A group that is too large in a bucket, or in all of them together, goes on with all its suffixes.
        over = cut(
            border.groupBy("lead").count().filter(F.col("count") > frequent).select("lead").union(large.select("lead")).distinct()
        )
        done.append(_over_borders(border.join(over, "lead", "left_anti"), window))
        if over.isEmpty():
            break
        suffixes = _divided(border.join(over, "lead", "left_semi").union(large), wide, window)
    return reduce(DataFrame.union, done)


def _numbered(docs: DataFrame, key: str, text: str, carry: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(ref, text, digest, c0...) of every row, the last being the columns to carry, and (ref, key) where they are not the same.

    Keys that are unique are the refs.  Otherwise (repeated or null keys) rows are numbered by key, nulls last, and then
    by digest, so that repeated rows share a number.
    """
    others = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        *[F.col(c).alias(o) for c, o in zip(carry, others)],
    )
    state = rows.agg(F.count("*").alias("n"), F.count_distinct("key").alias("d")).first()
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    if state["n"] == state["d"]:
        return rows.select(F.col("key").cast("bigint").alias("ref"), "text", "digest", *others), None
    ids = rows.select("key", "digest").distinct().sort(F.col("key").asc_nulls_last(), "digest")
    schema = T.StructType([*ids.schema.fields, T.StructField("ref", T.LongType())])
    numbered = cut(ids.sparkSession.createDataFrame(ids.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema))
    a, b = rows.alias("a"), numbered.alias("b")
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.digest") == F.col("b.digest"))
    return cut(a.join(b, same).select("b.ref", "a.text", "a.digest", *[f"a.{o}" for o in others])), numbered.select("ref", "key")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   frequent: int = FREQUENT, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, carry...) of every row; kept has the remaining bytes.

    A null text counts as empty; texts shorter than a window keep everything.  A null key counts as larger than all
    others.  Different texts under one key are ordered by their SHA-256; repeated rows (same key and text) are one
    document and each get its result.  An empty table gives no rows.  Column names of ``docs`` do not matter beyond
    ``key`` and ``text``; those named in ``carry`` come along.
    """
    if not gram < window < 128 or gram < 1:
        raise ValueError("1 <= gram < window < 128")
    rows, keys = _numbered(docs, key, text, list(carry))
    # Whole copies: all but the first of equal texts go.
    size = F.octet_length("text").cast("bigint")
    long = rows.filter(size >= window).select("ref", "digest", size.alias("end"))
    # Written, so that Spark can split the join where one text has very many copies.
    first = cut(
        long.groupBy("digest").agg(F.min("ref").alias("first"), F.max("ref").alias("last")).filter("last > first")
        .select("digest", "first")
    )
    copies = cut(
        long.join(first, "digest").filter(F.col("ref") > F.col("first"))
        .select("ref", F.lit(0).cast("bigint").alias("start"), "end")
    )
    others = [f"c{i}" for i in range(len(carry))]
    texts = pack(rows.select("ref", "text", *others))
    found = find_anchors(texts.join(copies.select("ref").distinct(), "ref", "left_anti"), window, gram)
    # Written, so that Spark can split the join where one gram has very many anchors; a merge, as eight bytes a gram in
    # the file are ten times that in a broadcast.
    twice = cut(found.groupBy("h").count().filter("count > 1").select("h"))
    places = (
        found.join(twice.hint("merge"), "h").select("ref", "place").groupBy("ref").agg(F.array_distinct(F.collect_list("place")).alias("places"))
    )
    suffixes = _suffixes(texts.join(places, "ref"), window, gram)
    cuts = (
        _cuts(suffixes, window, frequent, chunk).union(copies)
        .groupBy("ref").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    )

    schema = T.StructType([
        T.StructField("ref", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept", T.BinaryType()), *[rows.schema[o] for o in others],
    ])

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, spans, kept = [], [], [], []
        cuts = batch.column("cuts")
        for k, text in enumerate(unpacked(batch)):
            sizes.append(len(text))
            if not cuts[k].is_valid:
                removed.append(0)
                spans.append(0)
                kept.append(text)
                continue
            start, end = (cuts[k].values.field(i).to_numpy() for i in range(2))
            order = np.lexsort((end, start))
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.concatenate(([True], start[1:] > end[:-1]))
            begin, stop = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
            removed.append(int((stop - begin).sum()))
            spans.append(len(begin))
            kept.append(b"".join(text[a:b] for a, b in zip([0, *stop.tolist()], [*begin.tolist(), len(text)])))
        columns = [batch.column("ref"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *(batch.column(o) for o in others)], names=schema.names)

    out = map_batches(texts.join(cuts, "ref", "left"), apply, schema)
    if keys is None:
        named = F.col("ref").cast(docs.schema[key].dataType)
    else:
        out, named = out.join(keys, "ref"), F.col("key")
    return out.select(
        named.alias(key), "n_bytes", "n_removed", "n_spans", "kept", *[F.col(o).alias(c) for o, c in zip(others, carry)]
    )


def as_text(df: DataFrame, kept: str, text: str) -> DataFrame:
    """Replace a binary column by a text column without the characters that lost some of their bytes."""
    others = [f for f in df.schema.fields if f.name not in (kept, text)]
    schema = T.StructType([*others, T.StructField(text, T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(v.as_py() or b"").decode("utf-8", "ignore") for v in batch.column(kept)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name) for f in others), pa.array(texts, pa.string())], names=schema.names
        )

    return map_batches(df, run, schema)

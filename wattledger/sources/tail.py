"""Streaming source over growing spool files: only appended, complete lines are read.

Spark's file source tracks whole files; event spools are appended to.  Offsets here are bytes per
file.  The driver lists sizes and looks for the last newline of files that grew; the byte ranges are
cut into pieces of bounded size and read by executors, once and in order, each piece taking the
lines that start in it.

    spark.dataSource.register(SpoolTail)
    spark.readStream.format("spool_tail").load("/shared/spool")

Options: ``maxReadBytes`` (longest line; a longer one comes as a short sample with ``oversized`` set
and its true size in ``bytes``), ``maxBytesPerTrigger`` (of each batch; not for drains, which take
one batch; after a restart the first batch is not limited), ``lineNumbers`` (``true`` also numbers lines,
for which the file is read up to each piece; ``pieces`` numbers them inside their piece and adds a row
without a line for each piece, with its number of lines, from which ``number_lines`` makes numbers of
the file without reading anything twice), ``flushRows`` and ``flushSeconds`` (with either, new lines wait
until so many have gathered, so many seconds have passed since the last batch, or a file is there that no
batch has had; the first batch after a start does not wait.  The trigger then only sets how often the
source looks), ``published`` (a file that ``spool.write_spool`` keeps: only the files and sizes it names are seen,
so files that are written together arrive together).  A file that shrank is read again from its start, with
``truncated`` set.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wattledger.schemas import MAX_READ_BYTES, REJECT_SAMPLE_BYTES
from wattledger.sources.spool import FILE_PATTERN, published_sizes

SCHEMA = (
    "file_name string, collector_file string, session_file string, origin string, byte_offset bigint, "
    "line_number bigint, line string, oversized boolean, truncated boolean, bytes bigint, piece_offset bigint"
)
BLOCK = 1 << 20
#: Bytes that one task reads, about, where pieces are smaller; and the least that is read at once.
TASK_BYTES, LEAST_READ = 8 << 20, 1 << 14


class SpoolTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spool_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> "SpoolTailReader":
        limit = self.options.get("maxBytesPerTrigger")
        rows, seconds = self.options.get("flushRows"), self.options.get("flushSeconds")
        return SpoolTailReader(
            self.options["path"], int(self.options.get("maxReadBytes", MAX_READ_BYTES)), int(limit) if limit else None,
            self.options.get("lineNumbers", "false").lower() == "true", self.options.get("lineNumbers", "").lower() == "pieces",
            int(rows) if rows else None, float(seconds) if seconds else None, self.options.get("published"),
        )


class Published(NamedTuple):
    """A file as its writer announced it."""

    path: str
    base_name: str
    size: int


class Piece(InputPartition):
    def __init__(self, name: str, first: int, start: int, end: int, truncated: bool):
        self.name, self.first, self.start, self.end, self.truncated = name, first, start, end, truncated


class Pieces(InputPartition):
    """Pieces of one file that lie behind one another, for one task."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


class SpoolTailReader(DataSourceStreamReader):
    def __init__(
        self, path: str, max_read: int, limit: int | None = None, numbered: bool = False, pieces: bool = False,
        flush_rows: int | None = None, flush_seconds: float | None = None, published: str | None = None,
    ):
        self.published = published
        self.path, self.max_read, self.limit, self.numbered, self.pieces = path, max_read, limit, numbered, pieces
        self.flush_rows, self.flush_seconds, self.clock = flush_rows, flush_seconds, time.monotonic
        self.flushed: float | None = None  # when the last batch was let through
        self.behind = False  # whether a limit kept back some of that batch, which does not wait then
        self.gathered: dict[str, tuple[int, int]] = {}  # how far each file's waiting lines are counted, and how many they are
        self.seen: dict[str, tuple[int, int]] = {}  # size of each file and the end of its last whole line
        self.reached: dict[str, int] | None = None  # where the last batch ended, once that is known

    def _open(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            filesystem, root = fs.FileSystem.from_uri(self.path)
        else:
            filesystem, root = fs.LocalFileSystem(), self.path
        return filesystem, root.rstrip("/")

    def _complete_end(self, filesystem, path: str, size: int) -> int:
        """Offset just past the last newline, found from the end of the file."""
        step = 64 * 1024
        with filesystem.open_input_file(path) as f:
            high = size
            while high > 0:
                low = max(0, high - step)
                f.seek(low)
                at = f.read(high - low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                high = low
        return 0

    def initialOffset(self) -> dict:
        self.reached = {}
        return {}

    def _listed(self, filesystem, root: str) -> list:
        """The spool files there are, with path, name and size."""
        from pyarrow import fs

        if self.published is None:
            found = filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True))
            return [i for i in found if i.type == fs.FileType.File and re.match(FILE_PATTERN, i.base_name)]
        known = published_sizes(self.published)
        return [Published(f"{root}/{name}", name, size) for name, size in known.items() if re.match(FILE_PATTERN, name)]

    def latestOffset(self) -> dict:
        from concurrent.futures import ThreadPoolExecutor

        filesystem, root = self._open()
        listed = self._listed(filesystem, root)
        grown = [i for i in listed if self.seen.get(i.base_name, (None, 0))[0] != i.size]
        with ThreadPoolExecutor(16) as pool:
            ends = pool.map(lambda i: self._complete_end(filesystem, i.path, i.size), grown)
            self.seen.update({i.base_name: (i.size, end) for i, end in zip(grown, ends)})
        offsets = {i.base_name: self.seen[i.base_name][1] for i in sorted(listed, key=lambda i: i.base_name)}
        if self.flush_rows is not None or self.flush_seconds is not None:
            if not self._due(filesystem, root, offsets):
                return self.reached
            self.flushed, self.gathered = self.clock(), {}
        if self.limit and self.reached is not None:
            limited = self._limited(filesystem, root, offsets)
            self.behind, offsets = limited != offsets, limited
        self.reached = offsets
        return offsets

    def _due(self, filesystem, root: str, offsets: dict) -> bool:
        """Whether what is new should be a batch now."""
        if self.reached is None or self.flushed is None or self.behind:
            return True
        new = {name: end for name, end in offsets.items() if end != self.reached.get(name, 0)}
        if not new:
            return False
        if any(not self.reached.get(name) or end < self.reached[name] for name, end in new.items()):
            return True
        if self.flush_seconds is not None and self.clock() - self.flushed >= self.flush_seconds:
            return True
        return self.flush_rows is not None and self._gather(filesystem, root, new) >= self.flush_rows

    def _gather(self, filesystem, root: str, new: dict) -> int:
        """Lines that wait.  Each byte is counted once, and no more of them than it takes to reach ``flushRows``."""
        total = sum(lines for _, lines in self.gathered.values())
        for name, end in new.items():
            at, lines = self.gathered.get(name, (self.reached[name], 0))
            if at < end and total < self.flush_rows:
                with filesystem.open_input_file(f"{root}/{name}") as f:
                    f.seek(at)
                    while at < end and total < self.flush_rows and (block := f.read(min(BLOCK, end - at))):
                        found = block.count(b"\n")
                        at, lines, total = at + len(block), lines + found, total + found
                self.gathered[name] = (at, lines)
        return total

    def _limited(self, filesystem, root: str, offsets: dict) -> dict:
        """Ends that take no more than the limit, but at least one line, beyond the last ones; files by name."""
        left, out = self.limit, {}
        for name, end in offsets.items():
            since = self.reached.get(name, 0)
            if end > since:
                if left <= 0:
                    end = since
                elif end - since > left:
                    whole = self._complete_end(filesystem, f"{root}/{name}", since + left)
                    end = whole if whole > since else self._next_line(filesystem, f"{root}/{name}", since + left)
                left -= end - since
            out[name] = end
        return out

    def _next_line(self, filesystem, path: str, at: int) -> int:
        with filesystem.open_input_file(path) as f:
            f.seek(at)
            while block := f.read(BLOCK):
                cut = block.find(b"\n")
                if cut >= 0:
                    return at + cut + 1
                at += len(block)
        return at

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        tasks, together = [], max(1, TASK_BYTES // self.max_read)
        self.reached = dict(end)
        for name, to in end.items():
            since = start.get(name, 0)
            truncated = to < since
            if truncated:
                since = 0
            # An unchanged file yields no partition and is not opened.
            pieces = [Piece(name, since, low, min(low + self.max_read, to), truncated) for low in range(since, to, self.max_read)]
            tasks += [Pieces(pieces[k : k + together]) for k in range(0, len(pieces), together)]
        return tasks

    def read(self, task: Pieces) -> Iterator[tuple]:
        filesystem, root = self._open()
        with filesystem.open_input_file(f"{root}/{task.pieces[0].name}") as f:
            for piece in task.pieces:
                yield from self._read_piece(f, piece)

    def _read_piece(self, f, piece: Piece) -> Iterator[tuple]:
        collector, session = re.match(FILE_PATTERN, piece.name).groups()
        head = (piece.name, collector, session, f"{collector}:{session}")
        # A line belongs to the piece its first byte is in; the byte before says whether one begins here.
        inside = piece.start > piece.first
        number = 1 + self._newlines(f, piece.start - inside) if self.numbered else None
        f.seek(piece.start - inside)
        lines = 0
        for at, size, line in self._lines(f, piece.start - inside, piece.end):
            if inside:  # the end of a line that an earlier piece has
                inside = False
            else:
                lines += 1
                if size:
                    oversized = size > self.max_read
                    text = line.decode("utf-8", "replace") + ("…" if oversized else "")
                    yield (*head, at, lines if self.pieces else number, text, oversized, piece.truncated, size, piece.start)
            number = number + 1 if self.numbered else None
        if self.pieces:
            yield (*head, piece.start, lines, None, False, piece.truncated, 0, piece.start)

    def _newlines(self, f, until: int) -> int:
        f.seek(0)
        seen = 0
        while until > 0 and (block := f.read(min(until, BLOCK))):
            seen += block.count(b"\n")
            until -= len(block)
        return seen

    def _lines(self, f, at: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        """(start, size, line) of the lines that start before ``end``, from one pass; of too long ones a sample."""
        kept, size = [], 0
        # A small piece reads little more than itself, a long line more each time.
        while at < end and (block := f.read(min(BLOCK, max(end - at, size, LEAST_READ)))):
            begin = 0
            while at < end:
                cut = block.find(b"\n", begin)
                part = block[begin : cut if cut >= 0 else len(block)]
                if size <= self.max_read:
                    kept.append(part)
                size += len(part)
                if cut < 0:
                    break
                line = b"".join(kept)
                yield at, size, line if size <= self.max_read else line[:REJECT_SAMPLE_BYTES]
                at, begin, kept, size = at + size + 1, cut + 1, [], 0


def number_lines(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, counts) of a batch read with ``lineNumbers=pieces``: each line's number in its file, and the files' lines so far.

    ``known`` has (file_name, lines) of what earlier batches read; a prefix sum over the batch's pieces does the rest.
    Blank lines count, though they are not rows.  A file that is read again from its start begins at 1.
    """
    earlier = Window.partitionBy("file_name").orderBy("piece_offset").rowsBetween(Window.unboundedPreceding, -1)
    pieces = batch.where("line is null").groupBy("file_name", "piece_offset").agg(
        F.max("line_number").alias("lines"), F.bool_or("truncated").alias("anew")
    )
    before = F.when(F.col("anew"), F.lit(0)).otherwise(F.coalesce("known", F.lit(0)))
    placed = pieces.join(known.select("file_name", F.col("lines").alias("known")), "file_name", "left").withColumn(
        "before", (before + F.coalesce(F.sum("lines").over(earlier), F.lit(0))).cast("bigint")
    )
    lines = batch.where("line is not null").join(placed.select("file_name", "piece_offset", "before"), ["file_name", "piece_offset"])
    counts = placed.groupBy("file_name").agg(F.max(F.col("before") + F.col("lines")).alias("lines"))
    return lines.withColumn("line_number", F.col("line_number") + F.col("before")).drop("before"), counts

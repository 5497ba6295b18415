"""Keeping the stored tables: deduplicating appends, change-only upserts, one commit for all tables."""

from __future__ import annotations

import contextlib
import itertools
import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wattledger import schemas as S
from wattledger.functions import format_ms, ordered_counts, stable_id
from wattledger.operators.validate import event_lines
from wattledger.session import cut


def first_wins(batch: DataFrame, key: str = "event_id", arrival: str = "arrival") -> DataFrame:
    """One row per key, the earliest to arrive; of equally early ones the one with the smallest JSON.

    An aggregate rather than a window: copies collapse on the map side, so a key with very many
    copies is not gathered anywhere.
    """
    others = [c for c in batch.columns if c != key]
    order = F.struct(arrival, "json") if "json" in others else F.col(arrival)
    firsts = batch.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__row"))
    return firsts.select(key, "__row.*").select(*batch.columns)


def last_wins(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in ``order``."""
    others = [c for c in batch.columns if c != key]
    lasts = batch.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("__row"))
    return lasts.select(key, "__row.*").select(*batch.columns)


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "event_id", arrival: str = "arrival") -> DataFrame:
    """The rows an append would insert: first of each key, unless the key is stored already."""
    return first_wins(batch, key, arrival).join(stored.select(key), key, "left_anti")


def upserted(stored: DataFrame, batch: DataFrame, key: str = "event_id") -> DataFrame:
    """Stored rows with those of the batch put in their place (the batch has one row per key)."""
    return stored.join(batch.select(key), key, "left_anti").unionByName(batch)


def changed_joins(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh records that are new or differ from the stored one; a missing session id is filled in."""
    old = stored.select("unit_key", F.col("json").alias("old_json"), F.col("session_id").alias("old_session"))
    joined = fresh.join(old, "unit_key", "left")
    differs = ~F.col("json").eqNullSafe(F.col("old_json"))
    unfilled = F.col("old_json").isNotNull() & F.col("old_session").isNull() & F.col("session_id").isNotNull()
    return joined.where(differs | unfilled).withColumn("changed", differs).drop("old_json", "old_session")


# ---------------------------------------------------------------- Parquet tables


#: Parts of one level that are merged into one of the next.
MERGE = 16
#: Rows of a bucket of a keyed table, and ids under one filter of an append-only one, about.
BUCKET_ROWS, FILTER_ROWS = 1_000_000, 500_000
#: Probes of the Bloom filters that earlier versions wrote.
PROBES = 12
#: Ids of a batch that are held against a filter by one task, about.
TOGETHER = 1_000_000


def key_digits(key: str):
    """Hexadecimal digits that spread keys evenly; a bucket holds the keys whose digits begin with its name."""
    return F.md5(F.col(key).cast("string").cast("binary"))


def digits_for(rows: int, most: int) -> int:
    """How many digits divide so many rows into buckets of ``most`` or fewer, if they spread evenly."""
    digits = 0
    while rows > most * 16**digits:
        digits += 1
    return digits


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash's bits, one row for each probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((hashes & np.uint64(0xFFFFFFFF)) + turns * step) % np.uint64(bits)


def _filter_of(table: pa.Table) -> pa.Table:
    """One row with the filter and the range of a bucket's ids.

    The filter is the ids' hashes in order, with ``bits`` 0: at 64 bits an id it names a bucket in vain about once in
    2^64 pairs of ids, where a Bloom filter's rate would open some bucket of nearly every large batch.
    """
    hashes = np.unique(table.column("h").to_numpy().view(np.uint64))
    ids = table.column("id")
    return pa.table({
        "bucket": table.column("bucket").slice(0, 1), "rows": pa.array([table.num_rows], pa.int64()), "bits": pa.array([0], pa.int64()),
        "low": pa.array([pc.min(ids).as_py()], pa.string()), "high": pa.array([pc.max(ids).as_py()], pa.string()),
        "filter": pa.array([hashes.astype("<u8").tobytes()], pa.binary()),
    })


def _may_hold(packed: bytes, bits: int, hashes: np.ndarray) -> bool:
    """Whether a filter may hold one of the hashes; with ``bits`` it is a Bloom filter of that size."""
    if not bits:
        held = np.frombuffer(packed, "<u8")
        at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
        return bool((held[at] == hashes).any())
    data, may = np.frombuffer(packed, np.uint8), np.ones(len(hashes), bool)
    for at in _probes(hashes, bits):
        may &= (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return bool(may.any())


def _named_by_filters(ids: pa.Table, filters: pa.Table) -> pa.Table:
    """(part, bucket) of the filters that may hold one of the ids."""
    named = []
    if ids.num_rows and filters.num_rows:
        hashes = ids.column("h").to_numpy().view(np.uint64)
        values = ids.column("id")
        low, high = pc.min(values).as_py(), pc.max(values).as_py()
        for part, bucket, bits, first, last, packed in zip(*(filters.column(c).to_pylist() for c in ("part", "bucket", "bits", "low", "high", "filter"))):
            if first > high or last < low:
                continue
            inside = np.array(pc.and_(pc.greater_equal(values, first), pc.less_equal(values, last)))
            if _may_hold(packed, bits, hashes[inside]):
                named.append((part, bucket))
    return pa.table({"part": pa.array([p for p, _ in named], pa.string()), "bucket": pa.array([b for _, b in named], pa.string())})


class Store:
    """Parquet tables under one root; a commit names the parts of all of them.

    Writes go to new folders.  ``commit`` publishes one manifest with every table's parts and the last batch of each
    writer, so readers see all of a batch or nothing of it, and a batch that is delivered again is skipped.  Of two
    writers that start from the same manifest the second fails and changes nothing.

    Append-only tables (facts, opaque, rejects) are lists of parts.  Beside each part lie its ids, in buckets by their
    digits, and for every bucket the range of its ids and a filter, their hashes.  A batch is held against the filters, and only
    the buckets that these name are opened to see which of its ids are stored.  Small parts are merged into larger ones
    as they gather, each row about once per factor of ``merge_parts``.

    Merged facts lie in buckets by their session's digits, ordered by session and time; parts and buckets have filters of
    their sessions too, so a rebuild of some sessions (``facts_of``) opens what may hold them and nothing else.  A bucket
    is cut into files by ranges, so a very large session is read and written by many tasks.

    Keyed tables (estimates, joins) are buckets by the keys' digits, which the manifest maps to folders.  A merge
    rewrites the buckets that its keys fall into and no others; one that grows beyond ``bucket_rows`` is divided by
    further digits.
    """

    TABLES = {
        "facts": S.FACTS + ", json string",
        "opaque": "schema_version string, event_id string, ts string, collector string, session_id string, type string, arrival bigint, json string",
        "estimates": S.ESTIMATES,
        "joins": "unit_key string, session_id string, json string",
        "rejects": S.REJECTS,
        "line_counts": "file_name string, lines bigint",
        "dirty": "session_id string, since_ms bigint, samples_only boolean, zone string, dirty boolean",
    }
    #: The id of append-only tables and the key of keyed ones.
    IDS = {"facts": "event_id", "opaque": "event_id", "rejects": "key"}
    KEYS = {"estimates": "event_id", "joins": "unit_key", "dirty": "session_id", "line_counts": "file_name"}

    def __init__(
        self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS, filter_rows: int = FILTER_ROWS, merge_parts: int | None = None,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.bucket_rows, self.filter_rows, self.merge_parts = bucket_rows, filter_rows, merge_parts or MERGE
        self._fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._open: dict | None = None
        #: What the last append of each table opened, as (part, bucket), and which buckets the last merge rewrote.
        self.opened: dict[str, list[tuple[str, str]]] = {}
        #: What the last ``facts_of`` opened, as (part, bucket).
        self.visited: list[tuple[str, str]] = []
        self.rewritten: dict[str, list[str]] = {}

    # -- manifests

    def _manifests(self) -> list[str]:
        folder = self._fs_path(f"{self.root}/_commits")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _manifest(self, name: str | None = None) -> dict:
        name = name or max(self._manifests(), default=None)
        if name is None:
            return {"number": 0, "tables": {}, "batches": {}, "buckets": {}}
        found = json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/_commits/{name}", wholetext=True).collect()))
        return {"buckets": {}} | found

    def _state(self) -> dict:
        return self._open if self._open is not None else self._manifest()

    def _publish(self, state: dict) -> None:
        folder = self._fs_path(f"{self.root}/_commits")
        self._fs.mkdirs(folder)
        hidden = self._fs_path(f"{self.root}/_commit_{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        try:
            # Fails where the number is taken, so the second of two writers does not win.
            files.rename(hidden, self._fs_path(f"{self.root}/_commits/{state['number']:012d}"), never)
        except Exception as error:
            self._fs.delete(hidden, False)
            raise RuntimeError("another writer committed first; read again and repeat") from error

    @contextlib.contextmanager
    def commit(self, writer: str = "", batch_id: int | None = None) -> Iterator[bool]:
        """Publish all writes inside as one commit.  Gives False, and nothing should be written, for a batch that the
        writer has committed already.  Inside another commit it is part of that one.
        """
        if self._open is not None:
            yield True
            return
        state = self._manifest()
        if batch_id is not None and state["batches"].get(writer, -1) >= batch_id:
            yield False
            return
        shown = lambda s: json.dumps([s["tables"], s["buckets"]], sort_keys=True)
        before = shown(state)
        self._open = state | {"number": state["number"] + 1}
        try:
            yield True
            if batch_id is not None:
                self._open["batches"][writer] = batch_id
            if batch_id is not None or shown(self._open) != before:
                self._publish(self._open)
        finally:
            self._open = None

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the last ``keep``, and parts and buckets that none of those names."""
        names = self._manifests()
        held = set()
        for n in names[-keep:]:
            state = self._manifest(n)
            held |= {(t, p) for t, parts in state["tables"].items() for p in parts}
            held |= {(t, b["path"]) for t, buckets in state["buckets"].items() for b in buckets.values() if b["path"]}
        for name in names[:-keep]:
            self._fs.delete(self._fs_path(f"{self.root}/_commits/{name}"), False)
        kinds = [(t, f"{self.root}/{t}{suffix}") for t in self.TABLES for suffix in ("", ".ids", ".filters", ".sessions")]
        for table, place in kinds:
            folder = self._fs_path(place)
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                part = status.getPath().getName()
                inside = {p for t, p in held if t == table and p.startswith(f"{part}/")}
                if inside:  # a merge, some of whose buckets may be out of use
                    for bucket in self._fs.listStatus(status.getPath()):
                        name = bucket.getPath().getName()
                        if name.startswith("bucket=") and f"{part}/{name}" not in inside:
                            self._fs.delete(bucket.getPath(), True)
                elif (table, part) not in held:
                    self._fs.delete(status.getPath(), True)

    # -- tables

    def _parts(self, name: str) -> list[str]:
        return self._state()["tables"].get(name, [])

    def _buckets(self, name: str) -> dict[str, dict]:
        return self._state()["buckets"].get(name, {})

    def _read_parts(self, name: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.TABLES[name])
        # Buckets are names of folders and no columns.
        reader = self.spark.read.schema(self.TABLES[name]).option("recursiveFileLookup", "true")
        return reader.parquet(*[f"{self.root}/{name}/{p}" for p in parts])

    def _read_buckets(self, name: str, buckets: Iterable[str]) -> DataFrame:
        known = self._buckets(name)
        return self._read_parts(name, [known[b]["path"] for b in buckets if known[b]["path"]])

    def read(self, name: str) -> DataFrame:
        return self._read_parts(name, [*self._parts(name), *(b["path"] for b in self._buckets(name).values() if b["path"])])

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.TABLES[name]).columns

    def _write(self, name: str, df: DataFrame, level: int = 0) -> tuple[str, int]:
        """The new part's name and its rows."""
        part, seen = f"level{level}-{uuid.uuid4().hex}", Observation()
        rows = df.select(*self._columns(name)).observe(seen, F.count(F.lit(1)).alias("rows"))
        if level and name == "facts":
            total = df.count()
            bucket = F.substring(F.coalesce(key_digits("session_id"), F.lit("0" * 32)), 1, digits_for(total, self.bucket_rows))
            order = ("in_bucket", "session_id", "ts_ms")
            rows = df.select(*self._columns(name)).withColumn("in_bucket", F.concat(F.lit("b"), bucket))
            rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("in_bucket").parquet(f"{self.root}/{name}/{part}")
            return part, total
        rows.write.parquet(f"{self.root}/{name}/{part}")
        return part, seen.get["rows"]

    def append(self, name: str, df: DataFrame) -> int:
        with self.commit():
            part, rows = self._write(name, df)
            if rows:
                self._index(name, part, rows)
                self._state()["tables"][name] = self._merged(name, [*self._parts(name), part])
        return rows

    def _merged(self, name: str, parts: list[str], level: int = 0) -> list[str]:
        small = [p for p in parts if p.startswith(f"level{level}-")]
        if len(small) < self.merge_parts:
            return parts
        whole, rows = self._write(name, self._read_parts(name, small), level + 1)
        self._index(name, whole, rows)
        return self._merged(name, [*(p for p in parts if p not in small), whole], level + 1)

    def replace(self, name: str, df: DataFrame) -> None:
        with self.commit():
            self._state()["tables"][name] = [self._write(name, df)[0]]
            self._state()["buckets"].pop(name, None)

    # -- which ids are stored

    def _index(self, name: str, part: str, rows: int) -> None:
        """Write a part's ids in buckets, and a filter of each bucket."""
        if name not in self.IDS:
            return
        ids = self._read_parts(name, [part]).select(F.col(self.IDS[name]).cast("string").alias("id")).filter("id is not null")
        bucket = F.concat(F.lit("b"), F.substring(key_digits("id"), 1, digits_for(rows, self.filter_rows)))
        ids.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(
            f"{self.root}/{name}.ids/{part}"
        )
        stored = self.spark.read.schema("id string, bucket string").option("basePath", f"{self.root}/{name}.ids/{part}").parquet(
            f"{self.root}/{name}.ids/{part}"
        )
        self._write_filters(f"{name}.filters", part, stored)
        if name == "facts":
            digits = 0 if part.startswith("level0-") else digits_for(rows, self.bucket_rows)
            sessions = self._read_parts(name, [part]).select(F.col("session_id").alias("id")).filter("id is not null").distinct()
            self._write_filters("facts.sessions", part, sessions.withColumn("bucket", F.concat(F.lit("b"), F.substring(key_digits("id"), 1, digits))))

    def _write_filters(self, folder: str, part: str, ids: DataFrame) -> None:
        filters = ids.withColumn("h", F.xxhash64("id")).groupBy("bucket").applyInArrow(
            _filter_of, "bucket string, rows bigint, bits bigint, low string, high string, filter binary"
        )
        filters.select(F.lit(part).alias("part"), "*").write.parquet(f"{self.root}/{folder}/{part}")

    def _named(self, folder: str, parts: list[str], ids: DataFrame) -> list[tuple[str, str]]:
        """The (part, bucket) whose filters in a folder may hold some of ``ids``; parts without filters with an empty bucket."""
        known = [p for p in parts if self._fs.exists(self._fs_path(f"{self.root}/{folder}/{p}"))]
        plain = [(p, "") for p in parts if p not in known]
        if not known:
            return plain
        filters = self.spark.read.parquet(*[f"{self.root}/{folder}/{p}" for p in known])
        kinds = [r[0] for r in filters.select(F.length("bucket")).distinct().collect()]
        seen = cut(ids.withColumn("h", F.xxhash64("id")).withColumn("digits", key_digits("id")))
        salts = max(1, -(-seen.count() // TOGETHER))
        asked = seen.withColumn("width", F.explode(F.array(*[F.lit(k) for k in kinds]))).select(
            F.expr("concat('b', substring(digits, 1, width - 1))").alias("bucket"), F.pmod("h", F.lit(salts)).alias("salt"), "id", "h"
        )
        spread = filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        named = asked.groupBy("bucket", "salt").cogroup(spread.groupBy("bucket", "salt")).applyInArrow(
            _named_by_filters, "part string, bucket string"
        )
        return plain + sorted((r.part, r.bucket) for r in named.distinct().collect())

    def stored_among(self, name: str, ids: DataFrame) -> DataFrame:
        """The stored ids (``id``) of the buckets that may hold some of ``ids``, whose one column is called ``id``.

        ``opened`` tells which buckets those are.  Parts without filters are read whole.
        """
        self.opened[name] = self._named(f"{name}.filters", self._parts(name), ids)
        plain, hits = [p for p, b in self.opened[name] if not b], [(p, b) for p, b in self.opened[name] if b]
        whole = self._read_parts(name, plain).select(F.col(self.IDS[name]).cast("string").alias("id"))
        if not hits:
            return whole
        return whole.union(self.spark.read.schema("id string").parquet(*[f"{self.root}/{name}.ids/{p}/bucket={b}" for p, b in hits]))

    def facts_of(self, sessions: DataFrame) -> DataFrame:
        """The facts of some sessions (``session_id``), from the parts and buckets that may hold them."""
        wanted = sessions.select("session_id").where("session_id is not null").distinct()
        self.visited = self._named("facts.sessions", self._parts("facts"), wanted.select(F.col("session_id").alias("id")))
        paths = set()
        for part, bucket in self.visited:
            inside = f"{part}/in_bucket={bucket}"
            paths.add(inside if bucket and self._fs.exists(self._fs_path(f"{self.root}/facts/{inside}")) else part)
        return self._read_parts("facts", sorted(paths)).join(wanted, "session_id", "left_semi")

    def append_new(self, name: str, batch: DataFrame, arrival: str = "arrival") -> int:
        """Append the first row of each id that is not stored yet; rows that come again change nothing."""
        with self.commit():
            key = self.IDS[name]
            first = cut(first_wins(batch, key, arrival))
            stored = self.stored_among(name, first.select(F.col(key).cast("string").alias("id")))
            return self.append(name, first.join(stored.withColumnRenamed("id", key), key, "left_anti"))

    # -- keyed tables

    def _in_buckets(self, rows: DataFrame, key: str, buckets: Iterable[str]) -> DataFrame:
        """The rows with the bucket that holds each one's key, of buckets none of which begins with another."""
        names = list(buckets)
        widths = sorted({len(b) for b in names})
        if widths == [0]:
            return rows.withColumn("bucket", F.lit(""))
        listed = self.spark.createDataFrame([(b,) for b in names], "bucket string")
        return (
            rows.withColumn("__digits", key_digits(key)).withColumn("__width", F.explode(F.array(*[F.lit(w) for w in widths])))
            .withColumn("bucket", F.expr("substring(__digits, 1, __width)")).drop("__digits", "__width").join(listed, "bucket")
        )

    def touched(self, name: str, rows: DataFrame) -> dict[str, int]:
        """The buckets that rows fall into, and how many rows each gets."""
        known = self._buckets(name) or {"": None}
        counts = self._in_buckets(rows.select(self.KEYS[name]), self.KEYS[name], known).groupBy("bucket").count()
        return {r["bucket"]: r["count"] for r in counts.collect()}

    def stored_near(self, name: str, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that ``rows`` fall into."""
        if self._parts(name) or not self._buckets(name):
            return self.read(name)
        return self._read_buckets(name, self.touched(name, rows))

    def merge(self, name: str, rows: DataFrame) -> list[str]:
        """Put rows, one per key, in place of stored ones of the same key; gives the buckets that were rewritten."""
        key = self.KEYS[name]
        with self.commit():
            rows = cut(rows.select(*self._columns(name)))
            counts = self.touched(name, rows)
            known = dict(self._buckets(name))
            plain = self._parts(name)
            if plain:  # a table that was written as a whole: everything goes into buckets
                old = self.read(name)
                sizes = {"": old.count() + rows.count()}
                known = {}
            else:
                sizes = {b: n + (known[b]["rows"] if b in known else 0) for b, n in counts.items()}
                old = self._read_buckets(name, [b for b in counts if b in known])
            if not sizes:
                self.rewritten[name] = []
                return []
            fresh = {}
            for bucket, size in sizes.items():
                more = digits_for(size, self.bucket_rows)
                fresh |= {bucket + "".join(d): {"path": None, "rows": 0} for d in itertools.product("0123456789abcdef", repeat=more)}
            folder = f"merge-{uuid.uuid4().hex}"
            whole = self._in_buckets(upserted(old, rows, key), key, fresh).withColumn("bucket", F.concat(F.lit("b"), "bucket"))
            whole.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
            written = self.spark.read.schema(f"{self.TABLES[name]}, bucket string").parquet(f"{self.root}/{name}/{folder}")
            for r in written.groupBy("bucket").count().collect():
                fresh[r["bucket"][1:]] = {"path": f"{folder}/bucket={r['bucket']}", "rows": r["count"]}
            self._state()["tables"][name] = []
            self._state()["buckets"][name] = {b: v for b, v in known.items() if b not in sizes} | fresh
            self.rewritten[name] = sorted(sizes)
            return self.rewritten[name]

    # -- sinks

    def insert_events(self, facts: DataFrame) -> int:
        return self.append_new("facts", facts)

    def insert_opaque(self, events: DataFrame) -> int:
        return self.append_new("opaque", events)

    def upsert_estimates(self, batch: DataFrame) -> None:
        """Put the batch's estimates in place of stored ones; of several for one call the last in the batch stays."""
        last = last_wins(batch.withColumn("__at", F.monotonically_increasing_id()), "event_id", "__at").drop("__at")
        self.merge("estimates", last)

    def upsert_joins(self, records: DataFrame) -> int:
        """Write the records that changed and return how many did; no change writes nothing."""
        with self.commit():
            rows = cut(changed_joins(self.stored_near("joins", records), records))
            counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed")).first()
            if counts.n:
                self.merge("joins", rows.drop("changed"))
            return counts.changed

    def insert_rejects(self, rows: DataFrame, now_ms: int) -> int:
        """Add rejects to those stored; all are kept, and the newest are a read (``reads.recent_rejects``).

        A reject is one line: the same line at the same place is stored once, another line there is another reject.
        ``batch`` and ``id`` give the order of arrival.
        """
        with self.commit():
            keyed = rows.withColumns({
                "key": stable_id("reject", "origin", "id", "reason", "bytes", "digest"),
                "batch": F.lit(self._state()["number"]).cast("bigint"), "ts": format_ms(F.lit(now_ms).cast("bigint")),
            })
            return self.append_new("rejects", keyed, "id")

    def wipe_derived(self) -> None:
        with self.commit():
            for name in ("estimates", "joins"):
                self.replace(name, self.spark.createDataFrame([], self.TABLES[name]))


# ---------------------------------------------------------------- documents


def report_documents(summaries: DataFrame, records: DataFrame) -> DataFrame:
    """One JSON document per session, its joins sorted by unit key, in session order.

    A document lists all units of its session, so it is built per session; the cluster-wide report
    is the ordered rows, never one value.
    """
    listed = records.groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("unit_key", F.col("json").alias("join")))).alias("joins")
    )
    return (
        summaries.join(listed, "session_id", "left")
        .select(
            "session_id",
            F.to_json(
                F.struct(
                    "session_id",
                    F.map_from_entries("counts").alias("event_counts"),
                    "first_ts", "last_ts",
                    F.transform(
                        F.coalesce("joins", F.array().cast("array<struct<unit_key:string,join:string>>")),
                        lambda j: F.struct(j["unit_key"].alias("unit_key"), F.try_parse_json(j["join"]).alias("join")),
                    ).alias("joins"),
                )
            ).alias("document"),
        )
        .orderBy("session_id")
    )


def write_report_text(summaries: DataFrame, path: str) -> None:
    """Tab-separated report with its heading."""
    rows = summaries.select(
        F.col("session_id").alias("SESSION"), ordered_counts("counts").alias("EVENT_COUNTS"),
        F.col("first_ts").alias("FIRST_TS"), F.col("last_ts").alias("LAST_TS"),
    )
    rows.orderBy("SESSION").write.csv(path, sep="\t", header=True, quote="\u0000")


def write_event_lines(facts: DataFrame, path: str) -> None:
    """Canonical event lines, one folder per collector and session."""
    event_lines(facts).select("collector", "session_id", "value").write.partitionBy("collector", "session_id").text(path)

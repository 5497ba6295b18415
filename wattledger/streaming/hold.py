"""A bounded, durable queue of batches in front of a store that refuses them.

A batch that the store refuses is written to the queue and tried again, before any later one, with the next batch.  The
stream goes on meanwhile.  A batch keeps its number, by which the store skips what it has committed already, so a job
that dies between a commit and the queue's next state neither loses nor repeats anything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that are kept while the store refuses.
KEEP = 50_000


class HoldFull(RuntimeError):
    """The queue has no room and may not drop anything: the stream stops, and its source keeps the rest."""


class Hold:
    """Batches waiting for a store, oldest first, at most ``keep`` lines of them.

    Beyond that the oldest lines are dropped and counted in ``lost``; with ``drop=False`` the batch that does not fit
    raises ``HoldFull`` instead and stays in the source, whose checkpoint has not passed it.  Lines inside a batch are in
    the order of ``order``.

    The queue's state is a small file that is renamed into place; a state names the folders of all waiting batches.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP, drop: bool = True, order: Sequence[str] = ("byte_offset", "line")):
        self.spark, self.root, self.keep, self.drop, self.order = spark, root.rstrip("/"), keep, drop, list(order)
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        #: Why the store refused last.
        self.refusal: Exception | None = None

    # -- state

    def _states(self) -> list[str]:
        folder = self._path(f"{self.root}/_states")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def state(self) -> dict:
        """``waiting``: [number, folder, lines] of each batch in order; ``lost``: lines dropped so far."""
        name = max(self._states(), default=None)
        if name is None:
            return {"number": 0, "waiting": [], "lost": 0}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/_states/{name}", wholetext=True).collect()))

    def _publish(self, waiting: list, lost: int) -> None:
        earlier = self._states()
        number = 1 + max(map(int, earlier), default=0)
        self._fs.mkdirs(self._path(f"{self.root}/_states"))
        hidden = self._path(f"{self.root}/_state_{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps({"number": number, "waiting": waiting, "lost": lost}).encode()))
        out.close()
        if not self._fs.rename(hidden, self._path(f"{self.root}/_states/{number:012d}")):
            raise RuntimeError("the queue's state could not be written")
        # What the state before this one named, and nobody needs now.
        for name in earlier[:-1]:
            self._fs.delete(self._path(f"{self.root}/_states/{name}"), False)
        named = {folder for _, folder, _ in waiting}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("batch-") and name not in named:
                self._fs.delete(status.getPath(), True)

    def _read(self, folder: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")

    def _write(self, lines: DataFrame) -> list:
        folder = f"batch-{uuid.uuid4().hex}"
        lines.write.parquet(f"{self.root}/{folder}")
        return [folder, self._read(folder, lines.schema).count()]

    # -- the queue

    def _add(self, lines: DataFrame, batch_id: int) -> int:
        """Put a batch at the end; gives the lines that were dropped for it."""
        state = self.state()
        waiting = state["waiting"]
        if any(number == batch_id for number, *_ in waiting):  # it came before the job died
            return 0
        waiting.append([batch_id, *self._write(lines)])
        over = sum(n for *_, n in waiting) - self.keep
        if over > 0 and not self.drop:
            raise HoldFull(f"{self.keep} lines wait for the store already") from self.refusal
        lost = max(0, over)
        while over > 0:
            number, folder, n = waiting[0]
            if n <= over:
                waiting.pop(0)
            else:  # no more than ``keep`` lines stay of it
                newest = self._read(folder, lines.schema).orderBy(*[F.desc(c) for c in self.order]).limit(n - over)
                waiting[0] = [number, *self._write(newest)]
            over -= n
        self._publish(waiting, state["lost"] + lost)
        return lost

    def deliver(self, lines: DataFrame, batch_id: int, store: Callable[[DataFrame, int], dict[str, int]]) -> dict[str, int]:
        """Store what waits and then this batch, in order; from the first refusal on, batches wait.

        ``store(lines, number)`` commits one batch or raises, and skips a number it has committed.  Gives the sums of what
        it counts, with ``waiting`` and ``lost`` lines of the queue.
        """
        counts: dict[str, int] = {}
        waiting, refused = self.state()["waiting"], False
        for number, folder, _ in list(waiting):
            if number >= batch_id:  # this batch itself, held before its number was passed: it comes again now
                continue
            try:
                done = store(self._read(folder, lines.schema), number)
            except Exception as refusal:
                self.refusal, refused = refusal, True
                break
            for key, n in done.items():
                counts[key] = counts.get(key, 0) + n
            waiting = [w for w in waiting if w[0] != number]
            self._publish(waiting, self.state()["lost"])
        if not refused:
            try:
                for key, n in store(lines, batch_id).items():
                    counts[key] = counts.get(key, 0) + n
                if any(w[0] == batch_id for w in waiting):
                    self._publish([w for w in waiting if w[0] != batch_id], self.state()["lost"])
            except Exception as refusal:
                self.refusal, refused = refusal, True
        if refused:
            self._add(lines, batch_id)
        state = self.state()
        return counts | {"waiting": sum(n for *_, n in state["waiting"]), "lost": state["lost"]}

    def drain(self, schema, store: Callable[[DataFrame, int], dict[str, int]]) -> None:
        """Store everything that waits, as a clean stop does; a refusal is raised and the rest goes on waiting."""
        for number, folder, _ in self.state()["waiting"]:
            store(self._read(folder, schema), number)
            state = self.state()
            self._publish([w for w in state["waiting"] if w[0] != number], state["lost"])

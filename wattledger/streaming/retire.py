"""Keyed state with an end: sessions that retire by a timer, ids announced once, open spans of a bounded number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wattledger.schemas import IDLE_SESSION_MS

#: Ids that are remembered for each key, and spans of a key that may be open at a time.
REMEMBERED, OPEN_SPANS = 16_384, 512

RETIRED_SCHEMA = "session_id string, first_ms bigint, last_ms bigint, events bigint, retired_ms bigint"
ANNOUNCED_SCHEMA = "stream string, event_id string, seq bigint"
SPAN_SCHEMA = "session_id string, span_id string, seq bigint, outcome string"


class Retirement(StatefulProcessor):
    """Totals of a session while it is heard of; an event-time timer lets it go once it was silent for long enough."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "first_ms bigint, last_ms bigint, events bigint")

    def _retired(self, key, first: int, last: int, events: int) -> tuple:
        return key[0], first, last, events, last + self.idle_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(ms for part in rows for ms in part["ts_ms"].dropna().astype("int64").tolist())
        if key[0] is None or not times:  # rows that only move the watermark
            return
        held = self.totals.get() if self.totals.exists() else None
        out, before = [], held[1] if held else None
        for ms in times:
            if held and ms - held[1] >= self.idle_ms:  # heard of again: what went before is over
                out.append(self._retired(key, *held))
                held = None
            held = (min(held[0], ms), max(held[1], ms), held[2] + 1) if held else (ms, ms, 1)
        if before is not None and held[1] != before:
            self.handle.deleteTimer(before + self.idle_ms)
        if before != held[1]:
            self.handle.registerTimer(held[1] + self.idle_ms)
        self.totals.update(held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RETIRED_SCHEMA.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists():
            held = self.totals.get()
            if held[1] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.totals.clear()
                yield pd.DataFrame([self._retired(key, *held)], columns=[c.split()[0] for c in RETIRED_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def retire_sessions(events: DataFrame, idle_ms: int = IDLE_SESSION_MS, delay: str = "10 minutes") -> DataFrame:
    """Retired sessions of a stream of (session_id, ts_ms, event_time), once each time a session falls silent.

    A session's state is evicted when the watermark passes its last event by ``idle_ms``; one that is heard of later
    starts over, as a new session would.  Events later than ``delay`` may open a session again that has retired.
    """
    return events.withWatermark("event_time", delay).select("session_id", "ts_ms", "event_time").groupBy(
        "session_id"
    ).transformWithStateInPandas(Retirement(idle_ms), RETIRED_SCHEMA, "Append", "EventTime")


class _Order:
    """A first-in-first-out map in keyed state: names in the order of their places, oldest first, and their values."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.map = handle.getMapState(name, "name string", "place bigint, value bigint")

    def load(self) -> dict[str, tuple[int, int]]:
        found = {k[0]: (v[0], v[1]) for k, v in self.map.iterator()} if self.map.exists() else {}
        return dict(sorted(found.items(), key=lambda x: x[1][0]))

    def save(self, before: dict[str, tuple[int, int]], after: dict[str, tuple[int, int]]) -> None:
        for name in before:
            if name not in after:
                self.map.removeKey((name,))
        for name, value in after.items():
            if before.get(name) != value:
                self.map.updateValue((name,), value)


def _rows(parts: Iterator[pd.DataFrame], order: str) -> list:
    """The rows one micro-batch has for a key, in their order; the source's limit bounds them."""
    return sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: getattr(r, order))


class Announced(StatefulProcessor):
    """The last ids that were announced; an id is announced unless it is among them."""

    def __init__(self, remembered: int):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = _Order(handle, "ids")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.ids.load()
        held, out = dict(before), []
        place = max((p for p, _ in held.values()), default=0)
        for r in _rows(rows, "seq"):
            if r.event_id not in held:
                place += 1
                held[r.event_id] = (place, r.seq)
                out.append((key[0], r.event_id, r.seq))
                if len(held) > self.remembered:
                    del held[next(iter(held))]
        self.ids.save(before, held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANNOUNCED_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def announce_by_count(events: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """Events of a stream of (stream, event_id, seq) whose id is not among the last ``remembered`` announced of its stream.

    The oldest id goes when a new one comes; one that was only met again keeps its place.  Order is ``seq``, within and
    across micro-batches, as an ordered source delivers it.
    """
    return events.select("stream", "event_id", "seq").groupBy("stream").transformWithStateInPandas(
        Announced(remembered), ANNOUNCED_SCHEMA, "Append", "None"
    )


class OpenSpans(StatefulProcessor):
    """Open spans of a session in the order they opened; a close takes its span out, and the oldest makes room."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = _Order(handle, "opened")
        self.closed = handle.getMapState("closed", "span_id string", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.opened.load()
        held, out = dict(before), []
        place = max((p for p, _ in held.values()), default=0)
        for r in _rows(rows, "seq"):
            if r.is_closed:
                held.pop(r.span_id, None)
                self.closed.updateValue((r.span_id,), (r.seq,))
                out.append((key[0], r.span_id, r.seq, "closed"))
            elif r.span_id in held:  # news of an open span keeps its place
                held[r.span_id] = (held[r.span_id][0], r.seq)
            elif not self.closed.containsKey((r.span_id,)):
                place += 1
                held[r.span_id] = (place, r.seq)
                if len(held) > self.most:
                    oldest = next(iter(held))
                    out.append((key[0], oldest, held.pop(oldest)[1], "evicted"))
        self.opened.save(before, held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPAN_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def open_spans(updates: DataFrame, most: int = OPEN_SPANS) -> DataFrame:
    """Closes and evictions of a stream of (session_id, span_id, is_closed, seq), as (session_id, span_id, seq, outcome).

    A close replaces an open span; an opening never replaces a close.  Beyond ``most`` open spans of a session the one
    that opened first is evicted, with the ``seq`` of its last news.
    """
    return updates.select("session_id", "span_id", "is_closed", "seq").groupBy("session_id").transformWithStateInPandas(
        OpenSpans(most), SPAN_SCHEMA, "Append", "None"
    )

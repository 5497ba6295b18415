"""Keyed-state twins of the batch pairing: hook spans per session, provider per conversation.

State is the open records only.  On an ordered stream the result is the batch result; with late
records the batch form, run over the stored log, is the one that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SPAN_SCHEMA = (
    "session_id string, span_id string, arrival bigint, tool_name string, t_start_ms bigint, t_end_ms bigint, "
    "status string, swept boolean"
)
PROVIDER_SCHEMA = "conversation string, record_seq bigint, provider string"
# State of a call or conversation nobody closes is let go after this long in a resident query.
STATE_TTL_MS = 7 * 24 * 3_600_000


def _in_order(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """The rows one micro-batch has for a key; the batch size bounds them."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


class HookPairing(StatefulProcessor):
    """Open calls of a session: closed by their own record, swept at a stop."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getMapState("opened", "span_id string", "t_start_ms bigint, tool_name string", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        (session_id,) = key
        # Each look at the state is a call out of the worker: it is read once and what changed is written once.
        before = {span_id: value for (span_id,), value in self.opened.iterator()}
        opened, renewed, out = dict(before), set(), []
        for r in _in_order(rows, "arrival").itertuples(index=False):
            if r.event in ("Stop", "SessionEnd"):
                for span_id, (start, name) in sorted(opened.items()):
                    out.append((session_id, span_id, r.arrival, name, start, r.ts_ms, "unknown", True))
                opened.clear()
            elif r.tool_use_id == "":
                continue
            elif r.event == "PreToolUse":
                opened[r.span_id] = (r.ts_ms, r.tool_name)
                renewed.add(r.span_id)
            elif r.event in ("PostToolUse", "PostToolUseFailure"):
                found = opened.pop(r.span_id, None)
                ok = "ok" if r.event == "PostToolUse" else ("cancelled" if r.is_interrupt else "error")
                start, name = (found[0], r.tool_name or found[1]) if found else (r.ts_ms, r.tool_name)
                out.append((session_id, r.span_id, r.arrival, name, start, r.ts_ms, ok if found else "unknown", False))
        for span_id in before.keys() - opened.keys():
            self.opened.removeKey((span_id,))
        for span_id in renewed & opened.keys():
            self.opened.updateValue((span_id,), opened[span_id])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPAN_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


class ProviderCarry(StatefulProcessor):
    """Latest provider a conversation named, handed to its later calls."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.provider = handle.getValueState("provider", "provider string", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        current = self.provider.get()[0] if self.provider.exists() else None
        before, out = current, []
        for r in _in_order(rows, "record_seq").itertuples(index=False):
            if r.is_call:
                out.append((key[0], r.record_seq, current or "unknown"))
            if isinstance(r.named_provider, str):
                current = r.named_provider
        if current != before:
            self.provider.update((current,))
        if out:
            yield pd.DataFrame(out, columns=["conversation", "record_seq", "provider"])

    def close(self) -> None:
        pass


def _time_mode(ttl_ms: int | None) -> str:
    # State with a lifetime needs processing time, which keeps a query running; a drain has none.
    return "None" if ttl_ms is None else "ProcessingTime"


def pair_hooks(hooks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming spans of hook calls (columns as the batch form needs, plus the sanitised ``span_id``)."""
    return hooks.groupBy("session_id").transformWithStateInPandas(HookPairing(ttl_ms), SPAN_SCHEMA, "Append", _time_mode(ttl_ms))


def carry_provider(records: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming provider of each call; needs ``conversation, record_seq, is_call, named_provider``."""
    return records.groupBy("conversation").transformWithStateInPandas(
        ProviderCarry(ttl_ms), PROVIDER_SCHEMA, "Append", _time_mode(ttl_ms)
    )

"""The lifecycle as a keyed state machine over a stream of transition requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import ALLOWED

OUTPUT = "analysis_id string, seq bigint, target string, outcome string, status string"
_STATE = "status string"


def _step(status: str | None, expected: str | None, target: str, payload: str | None) -> tuple[str | None, str]:
    """New status and outcome of one request."""
    if expected is None:
        if target != "pending" or payload is not None:
            return status, "invalid"
        return ("pending", "applied") if status is None else (status, "conflict")
    if target not in ALLOWED.get(expected, ()) or (target == "completed") != (payload is not None):
        return status, "invalid"
    return (target, "applied") if status == expected else (status, "conflict")


def transitions(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Apply a stream of requests (analysis_id, seq, expected, target, payload) in seq order.

    Within a micro-batch requests of a key are ordered by seq; across batches the stream's
    order counts. With ``idle_ms`` an unfinished analysis that hears nothing for that long is
    emitted as failed (recovery of interrupted work).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        if state.hasTimedOut:
            if status in ("pending", "in_progress"):
                state.update(("failed",))
                yield pd.DataFrame([(key[0], None, "failed", "recovered", "failed")], columns=[
                    "analysis_id", "seq", "target", "outcome", "status"]).astype({"seq": "Int64"})
            return
        frames = list(batches)  # the requests of one analysis in one micro-batch
        out = []
        for frame in [pd.concat(frames).sort_values("seq")] if frames else []:
            for r in frame.itertuples(index=False):
                expected = None if pd.isna(r.expected) else r.expected
                payload = None if pd.isna(r.payload) else r.payload
                status, outcome = _step(status, expected, r.target, payload)
                out.append((key[0], r.seq, r.target, outcome, status))
        if status is not None:
            state.update((status,))
            if idle_ms is not None and status in ("pending", "in_progress"):
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["analysis_id", "seq", "target", "outcome", "status"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return events.groupBy("analysis_id").applyInPandasWithState(run, OUTPUT, _STATE, "append", timeout)

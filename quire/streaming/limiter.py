"""The sliding-window limiter as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.limiter import LIMITS, decide

OUT = "`group` string, caller string, event_id bigint, limited boolean, retry_after bigint"


def limited_stream(log: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Decisions over a stream of (group string, caller string, micros bigint, event_id bigint).

    A caller's state is the times of its accepted requests, as many as the
    allowance at most; it is dropped when no request came for a window. Rows of
    one batch are taken in order of (micros, event_id). limits has (requests,
    seconds) of each group; other groups are never limited.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        allowance, seconds = limits.get(key[0], (0, 0))
        seen: list[int] = list(state.get[0]) if state.exists else []
        rows: Any = pd.concat(list(frames)).sort_values(["micros", "event_id"])
        out = []
        for t, e in zip(rows["micros"].tolist(), rows["event_id"].tolist(), strict=True):
            seen, over, wait = decide(seen, t, allowance, seconds * 1_000_000)
            out.append((key[0], key[1], e, over, wait))
        state.update((seen,))
        state.setTimeoutDuration(max(1, seconds) * 1000)
        yield pd.DataFrame(out, columns=["group", "caller", "event_id", "limited", "retry_after"])

    return log.groupBy("group", "caller").applyInPandasWithState(step, OUT, "seen array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)

"""The recheck gate as a stream: state per key with a time to live, in event time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, ts timestamp, status string, due boolean"


def recheck(events: DataFrame, minutes: dict[str, int], delay: str = "0 seconds", ttl_days: int = 365) -> DataFrame:
    """events (key, ts TIMESTAMP, status): for each event whether its key was due, that is new or last let through at least the minutes of its
    stored status ago. Late events beyond the watermark are dropped by Spark; events of a batch are taken in order of time. A key's state ends
    `ttl_days` after its last event let through, when the watermark has passed that; the key then counts as new, which changes no answer as long
    as the minutes are no more than that."""
    wait = {s: np.timedelta64(60 * m, "s") for s, m in minutes.items()}

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at, status = state.get if state.exists else (None, None)
        at = None if at is None else np.datetime64(pd.Timestamp(at).to_datetime64())
        rows = pd.concat(list(frames)).sort_values(["ts", "status"], kind="stable")
        ts, names = rows["ts"].to_numpy(), rows["status"].to_numpy()
        due, i = np.zeros(len(ts), bool), 0
        while i < len(ts):  # from one event let through to the next
            if at is not None:
                i = max(i, int(np.searchsorted(ts, at + wait.get(status, np.timedelta64(0, "s")))))
                if i >= len(ts):
                    break
            due[i], at, status = True, ts[i], names[i]
            i += 1
        state.update((pd.Timestamp(at).to_pydatetime(), status))
        end = int(pd.Timestamp(at).timestamp() * 1000) + ttl_days * 86_400_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "ts": ts, "status": names, "due": due})

    return events.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, OUT, "at timestamp, status string", "append", GroupStateTimeout.EventTimeTimeout)


def first_reports(hits: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each URL reported once within the watermark. hits: url, ts."""
    return hits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])

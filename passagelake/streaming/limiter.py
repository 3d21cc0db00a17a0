"""The sliding-window limiter and the detection of dead workers over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..conf import SETTINGS
from ..operators.observe import admit

DECIDED = "key string, seq bigint, t double, kind string, allowed boolean, retry_after bigint"
REAPED = "job_id string, heartbeat_at timestamp"


def stream_rate_limit(attempts: DataFrame, most: int, window: float) -> DataFrame:
    """Decisions for a stream of attempts (key, seq, t, kind); a key's state is the ``most`` last allowed times.

    t is in seconds of event time, 0 or more. The watermark waits a window for late rows; those that come later yet get no decision. A key whose last attempt is a window
    behind the watermark is forgotten, as its times count no more.
    """
    later = window + 1  # so that times near 0 lie above the first watermark

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        hits = list(state.get[0]) if state.exists else []
        allowed, retry, hits = admit(rows["t"].tolist(), rows["kind"].tolist(), hits, most, window)
        state.update((hits,))
        state.setTimeoutTimestamp(max(int((float(rows["t"].max()) + later + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=allowed, retry_after=pd.array(retry, dtype="Int64"))[["key", "seq", "t", "kind", "allowed", "retry_after"]]

    timed = attempts.withColumn("at", F.timestamp_seconds(F.col("t") + later)).withWatermark("at", f"{window} seconds")
    return timed.groupBy("key").applyInPandasWithState(decide, DECIDED, "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_reap(heartbeats: DataFrame, seconds: int = SETTINGS.stale_seconds) -> DataFrame:
    """Jobs (job_id, ts, status) whose last heartbeat is older than the limit by event time, unless an end came last. At the same time an end counts as later."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "heartbeat_at": [pd.Timestamp(last, unit="ms")]})
            return
        rows = pd.concat(list(batches))
        newest = rows["ts"].max()
        last, before = int(newest.timestamp() * 1000), state.get[0] if state.exists else 0
        if last >= before and (rows.loc[rows["ts"] == newest, "status"] != "running").any():
            state.remove() if state.exists else None
            return
        last = max(last, before)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    marked = heartbeats.withWatermark("ts", "0 seconds")
    return marked.groupBy("job_id").applyInPandasWithState(watch, REAPED, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)

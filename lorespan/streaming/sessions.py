"""Session state with a time to live: over tables by the last write, over streams as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespan.settings import DEFAULT


def live(writes: DataFrame, now: Column, ttl_s: int = DEFAULT.session_ttl_s) -> DataFrame:
    """The last state of each session of writes (session_id, written_at in seconds, state; a null state deletes), unless it is deleted or older than ttl_s."""
    order = Window.partitionBy("session_id").orderBy(F.col("written_at").desc(), F.col("state").desc_nulls_last())
    last = writes.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return last.where(F.col("state").isNotNull() & (F.col("written_at") + ttl_s > now))


def session_stream(writes: DataFrame, ttl_s: int = DEFAULT.session_ttl_s, expire: bool = True) -> DataFrame:
    """session_id, version, state of a stream of writes (session_id, written_at, state): each write with its number in its session. Sessions without a write for ttl_s are forgotten; without expire, never (bounded replays end only so)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["written_at", "state"], kind="stable")
        n = state.get[0] if state.exists else 0
        out = []
        for value in rows["state"]:
            n = 0 if value is None else n + 1
            out.append((key[0], n, value))
        state.update((n,))
        if expire:
            state.setTimeoutDuration(ttl_s * 1000)
        yield pd.DataFrame(out, columns=["session_id", "version", "state"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return writes.groupBy("session_id").applyInPandasWithState(run, "session_id string, version int, state string", "n int", "append", timeout)

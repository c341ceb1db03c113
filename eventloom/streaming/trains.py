"""Sequential operators on a stream of events (sorting, unit_id, sample_index, ts).

ts is the event time.  State per unit is two numbers, and a watermark ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drop_duplicates(events: DataFrame, censored: float, late: str = "1 minute") -> DataFrame:
    """The stream without events within ``censored`` samples after a kept one of their unit.

    Events of one unit must come in order between micro-batches; within one they are sorted.  ``late``: the delay of the watermark; a unit whose
    last event it has passed is forgotten, so the state holds only units that are alive, and ``late`` must be longer than the period.
    """

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("sample_index")
        kept = []
        for t in rows["sample_index"].tolist():
            if last is None or t - last > censored:
                kept.append(t)
                last = t
        seen = max(seen, int(rows["ts"].max().timestamp() * 1000))
        state.update((last, seen))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"sorting": key[0], "unit_id": key[1], "sample_index": kept})

    return (
        events.withWatermark("ts", late)
        .groupBy("sorting", "unit_id")
        .applyInPandasWithState(
            keep, "sorting string, unit_id long, sample_index long", "last long, seen long", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def consensus(events: DataFrame, keys: list[str], gap: str, at_least: int, late: str) -> DataFrame:
    """Sessions of events linked by gaps shorter than ``gap``, once they can't grow any more: size and mean time in them."""
    sessions = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap))
    found = sessions.agg(F.count(F.lit(1)).alias("size"), F.bround(F.avg("sample_index")).cast("long").alias("sample_index"))
    return found.where(F.col("size") >= at_least).select(*keys, "sample_index", "size")


def rates(events: DataFrame, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts of events per key in sliding windows of event time."""
    windows = events.withWatermark("ts", late).groupBy(*keys, F.window("ts", width, slide))
    return windows.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")

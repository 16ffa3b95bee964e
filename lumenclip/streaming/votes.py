"""Vote streams: the toggle state machine over a stream, and hourly counts of label events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def toggle_stream(votes: DataFrame) -> DataFrame:
    """seq, clip_id, label for each vote of a stream (seq, clip_id, vote); a clip's label is its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (now,) = state.get if state.exists else ("",)
        for b in [pd.concat(list(batches)).sort_values("seq")]:
            out = []
            for seq, vote in zip(b.seq, b.vote, strict=True):
                now = "" if now == vote else vote
                out.append((seq, key[0], now or "unlabel"))
            yield pd.DataFrame(out, columns=["seq", "clip_id", "label"])
        state.update((now,))

    return votes.groupBy("clip_id").applyInPandasWithState(step, "seq long, clip_id long, label string", "label string", "append", GroupStateTimeout.NoTimeout)


def hourly_counts(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each label by hour of ``ts``; later ones than ``late`` don't count."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "label").count()

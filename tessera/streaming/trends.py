"""Streaming forms of the stateful operators, and windows over events.

Sample intake and the install ledger keep their state by key. The windows at the end
go beyond the catalog's own operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.schema import TrendConfig


def take_up(kept: list[tuple[int, float]], samples: list[tuple[int, float]], config: TrendConfig) -> list[tuple[int, float]]:
    """The kept samples (ts, downloads) after new ones in order of time."""
    kept = list(kept)
    for ts, downloads in sorted(samples):
        if kept and ts - kept[-1][0] < config.min_interval_ms:
            kept[-1] = (kept[-1][0], max(kept[-1][1], downloads))
        else:
            kept = [*kept, (ts, downloads)][-config.max_samples :]
    return kept


def ingest_stream(samples: DataFrame, config: TrendConfig = TrendConfig(), expire: bool = False) -> DataFrame:
    """(id, ts, downloads): the kept samples of each id that a batch touches. State is at most max_samples a key.

    With `expire`, for streams that run on, it goes keep_days after a key's last
    sample; a trigger that ends when its input does would wait for that.
    """

    def update(key, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get)) if state.exists else []
        new = [(int(t), float(d)) for f in frames for t, d in zip(f["ts"], f["downloads"])]
        kept = take_up(kept, new, config)
        state.update(([t for t, _ in kept], [d for _, d in kept]))
        if expire:
            state.setTimeoutDuration(config.keep_days * 86_400_000)
        yield pd.DataFrame({"id": [key[0]] * len(kept), "ts": [t for t, _ in kept], "downloads": [d for _, d in kept]})

    return samples.groupBy("id").applyInPandasWithState(update, "id string, ts bigint, downloads double", "ts array<bigint>, downloads array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def installs_stream(changes: DataFrame) -> DataFrame:
    """(id, install_count, installed, last_change) from events (id, kind install or uninstall, ts): the ledger's row of each id that a batch touches."""

    def update(key, frames, state: GroupState):
        import pandas as pd

        count, installed, last = state.get if state.exists else (0, False, 0)
        for ts, kind in sorted((int(t), k) for f in frames for t, k in zip(f["ts"], f["kind"])):
            count, installed, last = count + (kind == "install"), kind == "install", ts
        state.update((count, installed, last))
        yield pd.DataFrame({"id": [key[0]], "install_count": [count], "installed": [installed], "last_change": [last]})

    return changes.groupBy("id").applyInPandasWithState(update, "id string, install_count bigint, installed boolean, last_change bigint", "n bigint, installed boolean, last bigint", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling or sliding windows of events (ts timestamp, event_type); what comes later than the watermark is left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by user in sessions that a pause ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))

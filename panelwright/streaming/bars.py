"""Bars of equal spans of time from single events, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from panelwright.sources.bars import GRAINS


def intraday_bars(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """(code, ts, open, high, low, close, volume) from events (event_type, ts, event_id, value).

    The same plan serves a batch and a stream; on a stream a bar comes out once the watermark has
    passed its end, and events more than ``late`` behind the newest are dropped. Ties of time go by
    event_id.
    """
    at = F.struct("ts", "event_id")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    bars = _spanned(events, "event_type", "ts", minutes, at, F.count("*"), "value", "value", "value", "value")
    return bars.select("code", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def coarser(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of a longer span from those of a shorter one that divides it, with their window ``w``."""
    at = F.window_time("w") if bars.isStreaming else F.col("w.start")
    return _spanned(bars.withColumn("at", at), "code", "at", minutes, "at", F.sum("volume"), "open", "high", "low", "close")


def _spanned(rows: DataFrame, code: str, ts: str, minutes: int, order, volume, opens: str, highs: str, lows: str, closes: str) -> DataFrame:
    return rows.groupBy(F.col(code).alias("code"), F.window(ts, f"{minutes} minutes").alias("w")).agg(
        F.min_by(opens, order).alias("open"), F.max(highs).alias("high"), F.min(lows).alias("low"), F.max_by(closes, order).alias("close"), volume.alias("volume")
    )


def all_grains(events: DataFrame, grains: Sequence[int] = GRAINS, late: str = "10 minutes") -> DataFrame:
    """(code, grain, ts, open, high, low, close, volume): the bars of every grain (minutes) in one plan, batch or stream.

    The bars of a grain are made of those of the longest grain before that divides it, in a chain of event-time windows; the
    events themselves are only looked at for the first. On a stream each bar comes out once the watermark has passed its end.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    made: dict[int, DataFrame] = {}
    for g in sorted(set(grains)):
        base = max((b for b in made if g % b == 0), default=None)
        if base is None:
            made[g] = _spanned(events, "event_type", "ts", g, F.struct("ts", "event_id"), F.count("*"), "value", "value", "value", "value")
        else:
            made[g] = coarser(made[base], g)
    parts = [bars.select("code", F.lit(g).alias("grain"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume") for g, bars in made.items()]
    return reduce(DataFrame.unionByName, parts)


class LateEvents(StreamingQueryListener):
    """Counts the events that the watermark has dropped, by query id, from every progress report since it was added.

    ``spark.streams.addListener(LateEvents())`` before the query starts.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + late

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def late_events(query: StreamingQuery) -> int:
    """Events that the watermark has dropped, in the progress reports that are still kept; ``LateEvents`` counts all."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])

"""Streaming forms of the operators: windows with watermarks, deduplication, and modules folded until complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per window; rows later than the watermark are dropped by the engine."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", lateness: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    out = timed.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def first_arrivals(elements: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Elements without the copies that arrive again within the watermark."""
    return elements.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["element_id"])


def modules(elements: DataFrame, tags: dict[str, str], quiet_minutes: float | None = None) -> DataFrame:
    """One row per file with the values of the wanted root tags, given out once a greater tag has been seen.

    Tags ascend within a file, so a tag beyond the largest wanted one is what a watermark is to time.  Wanted elements
    that come later are late and do not change what was given out.  With ``quiet_minutes``, a file that nothing
    comes for in that time is over: what is held of it is given out, if it has not been, and its state is dropped, so that the state follows the files in
    transit; such a query runs batches without data to look at its clocks.  Without, what was given out keeps one mark per file.
    """
    names = list(tags)
    highest = max(tags.values())
    by_tag = {t: n for n, t in tags.items()}
    empty = [None] * len(names)

    def row(key: tuple, held: list) -> pd.DataFrame:
        return pd.DataFrame({"file": [key[0]], **{n: [v] for n, v in zip(names, held, strict=False)}})

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [*empty, False]
        if state.hasTimedOut:
            state.remove()
            if not held[-1]:
                yield row(key, held)
            return
        complete = False
        for pdf in batches:
            for tag, value in zip(pdf["tag"], pdf["values_json"], strict=True):
                if held[-1]:
                    continue
                if tag in by_tag:
                    held[names.index(by_tag[tag])] = value
                elif tag > highest:
                    complete = True
        if complete and not held[-1]:
            yield row(key, held)
            held = [*empty, True]  # only that it was given out
        state.update(tuple(held))
        if quiet_minutes is not None:
            state.setTimeoutDuration(int(quiet_minutes * 60_000))

    out = "file string" + "".join(f", {n} string" for n in names)
    kept = "".join(f"{n} string, " for n in names) + "done boolean"
    roots = elements.where(F.size("path") == 0).select("file", "tag", "values_json")
    return roots.groupBy("file").applyInPandasWithState(fold, out, kept, "append", GroupStateTimeout.NoTimeout if quiet_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)

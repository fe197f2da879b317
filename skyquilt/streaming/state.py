"""Retention and progress throttling, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retained(kept: DataFrame, by: str, now: Column, most: int = 10, most_bytes: float = 4e9, max_age_s: float = 3600.0, ts: str = "ts", size: str = "bytes", tie: str = "event_id") -> DataFrame:
    """Images of each session that stay: the newest ``most``, within a total size and an age; the newest always may."""
    newest = Window.partitionBy(by).orderBy(F.col(ts).desc(), F.col(tie).desc())
    run = kept.withColumns({"place": F.row_number().over(newest), "total": F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    fresh = (now.cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double")) <= max_age_s
    return run.where((F.col("place") <= most) & ((F.col("total") <= most_bytes) | (F.col("place") == 1)) & fresh)


def throttled(progress: DataFrame, by: str, seq: str, units: str, total: int, reports: int) -> DataFrame:
    """Reports of cumulative progress that pass: ``reports`` a step at most, and its end."""
    w = Window.partitionBy(by).orderBy(seq)
    done = F.least(F.lit(total), F.sum(units).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = progress.withColumn("completed", done).withColumn("mark", F.floor(F.col("completed") * reports / total))
    before = F.lag("mark").over(w)
    return rows.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("mark") > F.col("__b"))).drop("__b")


def throttled_stream(progress: DataFrame, by: str, units: str, total: int, reports: int) -> DataFrame:
    """The same over a stream, with one running total and mark of state for each step."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, mark = state.get if state.exists else (0, -1)
        out = []
        for rows in batches:
            for u in rows[units]:
                done = min(total, done + int(u))
                now = done * reports // total
                if now > mark:
                    mark = now
                    out.append((key[0], done, now))
        state.update((done, mark))
        yield pd.DataFrame(out, columns=[by, "completed", "mark"])

    kind = progress.schema[by].dataType.simpleString()
    return progress.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, completed long, mark long", "done long, mark long", "append", "NoTimeout")


def retained_stream(kept: DataFrame, by: str, ts: str = "ts", size: str = "bytes", window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Images and bytes of each session by hour of event time; late rows past the watermark are left out."""
    return kept.withWatermark(ts, lateness).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("images"), F.sum(size).alias("bytes"))

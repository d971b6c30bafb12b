"""Event-time windows, deduplication and rate limits on streams, and sequential folds for batches."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_time(rows: DataFrame, fps: int = 25, frame: str = "frame", to: str = "at") -> DataFrame:
    """The rows with a timestamp made from the frame number, as watermarks need."""
    return rows.withColumn(to, F.timestamp_seconds(F.col(frame) / fps))


def windowed_counts(rows: DataFrame, by: list[str], length: str, slide: str | None = None, late: str = "10 seconds", at: str = "at") -> DataFrame:
    """``by, start, end, n``: tumbling or sliding counts, late rows up to ``late``."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.withWatermark(at, late).groupBy(span.alias("_w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def appearance_sessions(rows: DataFrame, by: list[str], gap: str = "200 milliseconds", late: str = "10 seconds", at: str = "at") -> DataFrame:
    """``by, start, end, n``: stretches of appearances with no gap above ``gap``."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("_w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def first_of_frame(rows: DataFrame, key: list[str], late: str = "10 seconds", at: str = "at") -> DataFrame:
    """The rows without repeats of a key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def recent_hits(rows: DataFrame, key: list[str], at_seconds: str, span: int = 60) -> DataFrame:
    """The rows with the number of hits of the key in the last ``span`` seconds (a hit at the cut-off is out)."""
    w = Window.partitionBy(*key).orderBy(at_seconds).rangeBetween(-(span - 1), 0)
    return rows.withColumn("hits", F.count("*").over(w))


def rate_limited(rows: DataFrame, key: list[str], at: str, most: int, span: float) -> DataFrame:
    """The rows with ``accepted``: at most ``most`` accepted ones in any ``span``.

    Only accepted hits count, so a row depends on earlier answers: a keyed fold.
    """
    schema = rows.withColumn("accepted", F.lit(True)).schema

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable")
        recent: deque = deque()
        out = []
        for t in part[at]:
            while recent and recent[0] <= t - span:
                recent.popleft()
            out.append(len(recent) < most)
            if out[-1]:
                recent.append(t)
        return part.assign(accepted=out)

    return rows.groupBy(*key).applyInPandas(fold, schema)


def clamped(points: DataFrame, key: list[str], cap: float, fps: int = 25) -> DataFrame:
    """``key, frame, x, y`` with steps cut to ``cap`` m/s along the track's own output, forwards and then backwards."""
    slim = points.select(*key, "frame", "x", "y")

    def walk(f, x, y):
        for k in range(1, len(f)):
            most = cap * abs(f[k] - f[k - 1]) / fps
            dx, dy = x[k] - x[k - 1], y[k] - y[k - 1]
            d = (dx * dx + dy * dy) ** 0.5
            if d > most:
                x[k], y[k] = x[k - 1] + dx * most / d, y[k - 1] + dy * most / d

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame", kind="stable")
        f, x, y = part["frame"].tolist(), part["x"].tolist(), part["y"].tolist()
        walk(f, x, y)
        f, x, y = f[::-1], x[::-1], y[::-1]
        walk(f, x, y)
        return part.assign(x=x[::-1], y=y[::-1])

    return slim.groupBy(*key).applyInPandas(fold, slim.schema)

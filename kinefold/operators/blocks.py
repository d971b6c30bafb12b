"""Recording lines cut into bounded blocks of one source and one stretch of time.

A source (match) or a track may hold any share of the rows, so nothing is grouped by
source alone: lines go to blocks of ``span`` frames, and lines near a border also go to
the neighbour (``halo``), where they serve as context only.  One shuffle of slim rows
(ids and coordinates, no strings) brings a block together; within it the newest version
of a line is kept, the first entry of an id, and readings are put in track order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames a second of the match clock.
FPS = 25
#: Frames in a block: five minutes.  At most SPAN + 2 HALO frames of one source meet in a task.
SPAN = 7500
#: Frames of context on either side: ten seconds.
HALO = 250


def coordinate(people: str, axis: int) -> Column:
    """Coordinate of every person: null unless ``xy`` has exactly two elements."""
    return F.transform(F.col(f"{people}.xy"), lambda v: F.when(F.size(v) == 2, F.get(v, F.lit(axis))))


def line_blocks(frames: DataFrame, span: int = SPAN, halo: int = HALO) -> DataFrame:
    """``match_id, block, frame, line_no, ids, xs, ys``: each line in its block, border lines in two.

    Lines without match or frame belong to no track and are left out.
    """
    line = frames.where(F.col("match_id").isNotNull() & F.col("frame").isNotNull()).select(
        "match_id", "frame", F.coalesce("line_no", F.lit(-1)).alias("line_no"),
        F.col("people.id").alias("ids"), coordinate("people", 0).alias("xs"), coordinate("people", 1).alias("ys"))
    own = F.floor(F.col("frame") / span)
    if not halo:
        return line.withColumn("block", own)
    reach = F.array_distinct(F.array(F.floor((F.col("frame") - halo) / span), own, F.floor((F.col("frame") + halo) / span)))
    return line.withColumn("block", F.explode(reach))


@dataclass
class Readings:
    """Readings of one block in track order; ``track`` counts tracks from 0, ``ids`` names them."""

    ids: np.ndarray
    track: np.ndarray
    frame: np.ndarray
    x: np.ndarray
    y: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.track, minlength=len(self.ids))

    def only(self, keep: np.ndarray) -> "Readings":
        """The kept readings; tracks that lose all of theirs disappear."""
        names, track = np.unique(self.track[keep], return_inverse=True)
        return Readings(self.ids[names], track, self.frame[keep], self.x[keep], self.y[keep])


def _floats(values: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False), dtype=np.float64)


def block_readings(lines: pa.Table) -> Readings:
    """Newest version of each frame's line, first entry of each id, sorted by id and frame."""
    frame = lines["frame"].to_numpy()
    number = lines["line_no"].to_numpy()
    order = np.lexsort((number, frame))
    ordered = frame[order]
    newest = order[np.append(ordered[1:] != ordered[:-1], True)] if len(order) else order
    take = pa.array(newest)
    ids = lines["ids"].combine_chunks().take(take)
    xs = lines["xs"].combine_chunks().take(take)
    ys = lines["ys"].combine_chunks().take(take)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
    row = np.repeat(np.arange(len(newest)), sizes)
    flat = ids.flatten()
    known = np.asarray(flat.is_valid())
    who = np.asarray(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), dtype=np.int64)[known]
    row = row[known]
    x, y = _floats(xs.flatten())[known], _floats(ys.flatten())[known]
    order = np.lexsort((row, who))  # stable: the first entry of an id stays first
    who, row = who[order], row[order]
    first = np.append(True, (who[1:] != who[:-1]) | (row[1:] != row[:-1])) if len(who) else np.zeros(0, dtype=bool)
    order, who, row = order[first], who[first], row[first]
    names, track = np.unique(who, return_inverse=True)
    return Readings(names, track, frame[newest][row], x[order], y[order])


def usable(r: Readings) -> Readings:
    """Readings whose position is two finite numbers."""
    return r.only(np.isfinite(r.x) & np.isfinite(r.y))

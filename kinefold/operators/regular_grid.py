"""Uneven readings onto a regular time grid (problem 5).

Consecutive readings of a track are paired by ``lead``; only the grid seconds between the
two readings of a pair are exploded and interpolated, or marked where the gap is too long.

Defined results: an empty table gives no rows; readings without usable position give none;
equal readings, late or repeated lines do not change the result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.operators.blocks import FPS, SPAN, line_blocks

MEASURED, FILLED, MISSING = "measured", "filled", "missing"


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def usable_readings(frames: DataFrame, span: int = SPAN) -> DataFrame:
    """``match_id, block, id, frame, x, y``: usable readings, laid out by (match_id, block)."""
    newest = Window.partitionBy("match_id", "block", "frame").orderBy(F.desc("line_no"))
    lines = (line_blocks(frames, span, 0).repartition("match_id", "block")
             .withColumn("_rank", F.row_number().over(newest)).where("_rank = 1"))
    people = F.arrays_zip("ids", "xs", "ys")
    first = F.filter(people, lambda p, i: (F.array_position("ids", p["ids"]) == i + 1))
    return (lines.select("match_id", "block", "frame", F.explode(first).alias("p"))
            .select("match_id", "block", F.col("p.ids").alias("id"), "frame", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))
            .where(F.col("id").isNotNull() & _finite(F.col("x")) & _finite(F.col("y"))))


def regular_seconds(frames: DataFrame, longest_fill_s: float = 3.0, fps: int = FPS, span: int = SPAN) -> DataFrame:
    """``match_id, id, sec_no, x, y, status``: one row per whole second of every track.

    The position is that at the start of the second (frame ``sec_no * fps``), interpolated
    between the readings before and after.  ``status``: measured (the second has a reading),
    filled (it has none, the gap is at most ``longest_fill_s``), missing (position null).
    The first second takes the first reading; a second that ends a long gap its own reading.

    Pairs inside a block need no further shuffle.  The first and last reading of a track in
    a block meet in a small group per track (two rows a block); all other rows pass the
    second window in groups of their block, so a long track is never gathered.
    """
    inside = Window.partitionBy("match_id", "block", "id").orderBy("frame")
    second = lambda c: F.floor(F.col(c) / fps)
    paired = usable_readings(frames, span).select(
        "match_id", "block", "id", "frame", "x", "y", F.lead("frame").over(inside).alias("nf"), F.lead("x").over(inside).alias("nx"),
        F.lead("y").over(inside).alias("ny"), F.lag("frame").over(inside).isNull().alias("head"))
    edge = F.col("head") | F.col("nf").isNull()
    kept = paired.where(edge | (second("nf") > second("frame")))
    across = Window.partitionBy("match_id", "id", F.when(edge, -1).otherwise(F.col("block"))).orderBy("frame")
    linked = kept.select(
        "match_id", "id", "frame", "x", "y", *[F.coalesce(c, F.lead(o).over(across)).alias(c) for c, o in (("nf", "frame"), ("nx", "x"), ("ny", "y"))],
        (F.col("head") & F.lag("frame").over(across).isNull()).alias("head"))
    start, end = F.when(F.col("head"), second("frame")).otherwise(second("frame") + 1), F.coalesce(second("nf"), second("frame"))
    grid = (linked.withColumn("_a", start).withColumn("_b", end).where("_a <= _b")
            .select("*", F.explode(F.sequence("_a", "_b")).alias("sec_no")))
    own, close, last = F.col("sec_no") == second("frame"), F.col("nf") - F.col("frame") <= longest_fill_s * fps, F.col("sec_no") == second("nf")
    share = (F.col("sec_no") * fps - F.col("frame")) / (F.col("nf") - F.col("frame"))
    at = lambda a, b: (F.when(own, F.col(a)).when(close, F.col(a) + (F.col(b) - F.col(a)) * share).when(last, F.col(b)))
    status = F.when(own | last, MEASURED).when(close, FILLED).otherwise(MISSING)
    return grid.select("match_id", "id", "sec_no", at("x", "nx").alias("x"), at("y", "ny").alias("y"), status.alias("status"))

"""Repeated consecutive events collapsed into one record (problem 2).

The row number of an event among all events of its entity, less its row number among the
events of its entity that say the same, is constant within a run and changes from run to run.

Entities may be long, so the numbering is done in blocks of time.  Runs inside a block are
final; the first and last run of an entity in a block meet those of the neighbouring blocks
in a small group of their own and are joined where they say the same.

Defined results: empty tables give no rows; unknown (null, or however written) is a value;
lines delivered again or replaced by a later version count as the newest version says;
entries without id belong to no entity; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.functions.labels import canonical_label, canonical_number
from kinefold.operators.blocks import FPS

# Labels that most rows carry in their plain spelling.
#: Frames in a block of runs: nothing is repeated at borders, so blocks can be short and even.
RUN_SPAN = 2500
ROLES = ("player", "goalkeeper", "referee")
TEAMS = ("left", "right")


def collapse_runs(events: DataFrame, entity: list[str], order: str, values: list[str], block: str) -> DataFrame:
    """``entity, values, first, last, events``: maximal runs of equal ``values`` (null equals null).

    ``events`` holds one row per entity and ``order``, and must carry ``block``, which does not
    fall as ``order`` grows.  Lay it out by a prefix of (entity, block) to save the shuffle.
    """
    told = F.concat_ws("\x1f", *[F.coalesce(F.col(v), F.lit("\x00")) for v in values])
    track = [*entity, block]
    marked = events.select(*track, order, told.alias("_told"))
    among_all = F.row_number().over(Window.partitionBy(*track).orderBy(order))
    among_equal = F.row_number().over(Window.partitionBy(*track, "_told").orderBy(order))
    runs = (marked.withColumn("_island", among_all - among_equal).groupBy(*track, "_told", "_island")
            .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("events")))
    inside = Window.partitionBy(*track).orderBy("first")
    ends = runs.select("*", F.lag("first").over(inside).isNull().alias("_head"), F.lead("first").over(inside).isNull().alias("_tail"))
    group = [*[F.col(e) for e in entity], F.when(F.col("_head") | F.col("_tail"), None).otherwise(F.col(block)).alias("_group")]
    across = Window.partitionBy(*entity, F.when(F.col("_head") | F.col("_tail"), None).otherwise(F.col(block))).orderBy("first")
    goes_on = F.col("_head") & F.lag("_tail").over(across) & (F.lag("_told").over(across) == F.col("_told"))
    joined = ends.select(*group, "_told", "first", "last", "events", F.when(goes_on, 0).otherwise(1).alias("_new"))
    number = F.sum("_new").over(Window.partitionBy(*entity, "_group").orderBy("first"))
    whole = (joined.withColumn("_run", number).groupBy(*entity, "_group", "_run", "_told")
             .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")))
    parts = F.split("_told", "\x1f", -1)
    said = [F.when(F.get(parts, F.lit(i)) != "\x00", F.get(parts, F.lit(i))).alias(v) for i, v in enumerate(values)]
    return whole.select(*entity, *said, "first", "last", "events")


def readings_with_labels(frames: DataFrame, span: int = RUN_SPAN) -> DataFrame:
    """``match_id, block, id, frame, role, team, jersey`` with canonical labels, laid out by (match_id, block)."""
    lines = (frames.where(F.col("match_id").isNotNull() & F.col("frame").isNotNull())
             .select("match_id", "frame", F.coalesce("line_no", F.lit(-1)).alias("line_no"), F.floor(F.col("frame") / span).alias("block"),
                     F.col("people.id").alias("ids"), F.col("people.role").alias("roles"), F.col("people.team").alias("teams"), F.col("people.jersey").alias("jerseys"))
             .repartition("match_id", "block"))
    newest = Window.partitionBy("match_id", "block", "frame").orderBy(F.desc("line_no"))
    people = F.filter(F.arrays_zip("ids", "roles", "teams", "jerseys"), lambda p, i: F.array_position("ids", p["ids"]) == i + 1)
    one = (lines.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
           .select("match_id", "block", "frame", F.explode(people).alias("p")))
    label = lambda c, usual: canonical_label(F.col(c), usual)
    return one.where(F.col("p.ids").isNotNull()).select(
        "match_id", "block", F.col("p.ids").alias("id"), "frame", label("p.roles", ROLES).alias("role"), label("p.teams", TEAMS).alias("team"),
        canonical_number(F.col("p.jerseys")).alias("jersey"))


def label_runs(frames: DataFrame, span: int = RUN_SPAN) -> DataFrame:
    """``match_id, id, role, team, jersey, start_frame, end_frame, readings, duration_s`` of every run."""
    runs = collapse_runs(readings_with_labels(frames, span), ["match_id", "id"], "frame", ["role", "team", "jersey"], "block")
    return runs.select("match_id", "id", "role", "team", "jersey", F.col("first").alias("start_frame"), F.col("last").alias("end_frame"),
                       F.col("events").alias("readings"), ((F.col("last") - F.col("first")) / FPS).alias("duration_s"))

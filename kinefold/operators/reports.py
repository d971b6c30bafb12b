"""Documents of a recording put together from its features: summary, report, comparison, territory.

Everything is joined by recording from aggregates of a row or a few per recording; nothing is
brought to the driver.  Defined results: a recording without players has counts of 0 and null
shapes; null lines, people and balls count as in the features; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinefold.operators.blocks import FPS
from kinefold.operators.features import territory
from kinefold.operators.recording import BALL_CAP, occupancy, player_summary, positioned, steps, team_shape

TEAMS = ("left", "right")
# The metrics of a comparison, in order.
METRICS = ("duration_s", "tracked_people", "team_width_left_m", "team_width_right_m", "team_length_left_m", "team_length_right_m", "avg_distance_m", "ball_found_pct")



def counted(players: DataFrame) -> DataFrame:
    """Players and keepers of a team."""
    return players.where(F.col("role").isin("player", "goalkeeper") & F.col("team").isin(*TEAMS))


def match_summary(p: DataFrame, lines: DataFrame, ball: DataFrame) -> DataFrame:
    """One row a recording: frames, duration, ``players`` (array of their summaries), ``teams`` (shape by side), ball and heat maps."""
    frames = lines.groupBy("match_id").agg(F.count("*").alias("frame_count"), F.round(F.count("*") / F.lit(float(FPS)), 2).alias("duration_s"))
    two = lambda c: F.round(c, 2).alias(c)
    person = F.struct("id", "role", "team", "jersey", "frames", two("seconds"), two("distance_m"), two("avg_speed_ms"), two("max_speed_ms"), "sprints")
    players = player_summary(p).groupBy("match_id").agg(F.array_sort(F.collect_list(person)).alias("players"))
    shape = team_shape(p).groupBy("match_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("team", F.struct("frames", two("x"), two("y"), two("width"), two("length")))))).alias("teams"))
    track = ball.where("x is not null").select("match_id", F.lit(0).alias("id"), "frame", "x", "y")
    moved = steps(track, cap=BALL_CAP).where("counted").groupBy("match_id").agg(F.round(F.sum("d"), 2).alias("ball_distance_m"))
    seen = ball.groupBy("match_id").agg(F.count("x").alias("ball_frames"))
    spots = counted(positioned(p)).select("match_id", F.col("team").alias("which"), "x", "y").unionByName(ball.where("x is not null").select("match_id", F.lit("ball").alias("which"), "x", "y"))
    heat = occupancy(spots, ["match_id", "which"]).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("which", "row", "col", "n"))).alias("heat"))
    out = frames
    for part in (players, shape, seen, moved, heat):
        out = out.join(part, "match_id", "left")
    return out.withColumn("ball_distance_m", F.coalesce("ball_distance_m", F.lit(0.0)))


def headline(summary: DataFrame) -> DataFrame:
    """``match_id, players, left_distance, right_distance, top_speed, sprints, ball_distance, ball_frames`` over counted players."""
    mine = F.filter("players", lambda q: q["role"].isin("player", "goalkeeper") & q["team"].isin(*TEAMS))
    total = lambda side: F.round(F.aggregate("_mine", F.lit(0.0), lambda s, q: s + F.when(q["team"] == side, q["distance_m"]).otherwise(0.0)), 2)
    return summary.withColumn("_mine", F.coalesce(mine, F.array())).select(
        "match_id", F.size("_mine").cast("bigint").alias("players"), total("left").alias("left_distance"), total("right").alias("right_distance"),
        F.coalesce(F.array_max(F.transform("_mine", lambda q: q["max_speed_ms"])), F.lit(0.0)).alias("top_speed"),
        F.aggregate("_mine", F.lit(0).cast("bigint"), lambda s, q: s + q["sprints"]).alias("sprints"), F.col("ball_distance_m").alias("ball_distance"), "ball_frames")


def top_players(players: DataFrame, most: int = 5) -> DataFrame:
    """``match_id, rank, id, jersey, distance_m, ...``: the counted players who ran furthest, ties to the smaller id, rank from 1."""
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc(F.round("distance_m", 2)), "id"))
    return counted(players).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)


def opacities(counts: DataFrame, by: list[str]) -> DataFrame:
    """Cell counts with ``opacity``: their share of the group's largest count, two decimals."""
    largest = F.max("n").over(Window.partitionBy(*by))
    return counts.withColumn("opacity", F.round(F.least(F.col("n") / F.greatest(F.lit(1), largest), F.lit(1.0)), 2))


def compared(summary: DataFrame, sides: DataFrame) -> DataFrame:
    """``position, name, a, b, diff`` of two recordings (``sides``: match_id, side "a" or "b"), all of ``METRICS`` in order.

    Values are rounded before they are subtracted; a metric that one side lacks has a null difference.
    """
    part = lambda side, c: F.round(F.col("teams")[side][c], 2)
    people = F.coalesce(F.size("players"), F.lit(0))
    distance = F.round(F.aggregate("players", F.lit(0.0), lambda s, q: s + q["distance_m"]) / people, 2)
    values = [F.col("duration_s"), people.cast("double"), part("left", "width"), part("right", "width"), part("left", "length"), part("right", "length"),
              F.when(people > 0, distance).otherwise(0.0), F.round(F.lit(100.0) * F.col("ball_frames") / F.col("frame_count"), 2)]
    long = summary.join(F.broadcast(sides), "match_id").select("side", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in zip(METRICS, values)])).alias("position", "m"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("m.value"))).alias(s)
    return long.groupBy("position", F.col("m.name").alias("name")).agg(pick("a"), pick("b")).withColumn("diff", F.round(F.col("a") - F.col("b"), 2))


def possession_percentages(timeline: DataFrame, lines: DataFrame, first: DataFrame, length: int = 7500) -> DataFrame:
    """``match_id, window, frames, left, right, none``: per cent of the recorded frames; ``window`` null is the whole recording."""
    window = F.floor((F.col("frame") - F.col("first_frame")) / length)
    rows = lines.select("match_id", "frame").join(first, "match_id").select("match_id", "frame", window.alias("window"))
    runs = timeline.join(first, "match_id").select(
        "match_id", "owner", "start_frame", "end_frame", "first_frame",
        F.explode(F.sequence(F.floor((F.col("start_frame") - F.col("first_frame")) / length), F.floor((F.col("end_frame") - F.col("first_frame")) / length))).alias("window"))
    from_ = F.greatest("start_frame", F.col("first_frame") + F.col("window") * length)
    owned = runs.withColumn("n", F.least("end_frame", F.col("first_frame") + F.col("window") * length + length - 1) - from_ + 1)
    frames = rows.groupBy("match_id", "window").agg(F.count("*").alias("frames"))
    by = owned.groupBy("match_id", "window").agg(*[F.sum(F.when(F.col("owner") == o, F.col("n")).otherwise(0)).alias(o) for o in (*TEAMS, "none")])
    sums = frames.join(by, ["match_id", "window"], "left").groupingSets([[F.col("match_id"), F.col("window")], [F.col("match_id")]], "match_id", "window").agg(*[F.sum(c).alias(c) for c in ("frames", *TEAMS, "none")])
    return sums.select("match_id", "window", "frames", *[F.round(F.lit(100.0) * F.coalesce(F.col(o), F.lit(0)) / F.col("frames"), 1).alias(o) for o in (*TEAMS, "none")])


def control_series(owned: DataFrame, catalog: DataFrame) -> DataFrame:
    """``match_id, second, left, right, neutral``: shares of the grid in every second, also those without a line (all neutral)."""
    seconds = catalog.select("match_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("last_frame") - F.col("first_frame")) / FPS))).alias("second"))
    joined = seconds.join(owned, ["match_id", "second"], "left")
    cells = F.coalesce("cells", F.lit(294))
    n = lambda side: F.coalesce(F.col(side), F.lit(0))
    share = lambda v: F.round(v / cells, 3)
    return joined.select("match_id", "second", share(n("left")).alias("left"), share(n("right")).alias("right"), share(cells - n("left") - n("right")).alias("neutral"))


def control_share(owned: DataFrame, catalog: DataFrame) -> DataFrame:
    """``match_id, left, right``: share of all cell seconds, one ratio rounded once."""
    whole = (F.floor((F.col("last_frame") - F.col("first_frame")) / FPS) + 1) * 294
    sums = owned.groupBy("match_id").agg(F.sum("left").alias("l"), F.sum("right").alias("r"))
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / whole, 3)
    return catalog.join(sums, "match_id", "left").select("match_id", share("l").alias("left"), share("r").alias("right"))


def control_map(p: DataFrame, lines: DataFrame, first: DataFrame, catalog: DataFrame) -> DataFrame:
    """``match_id, row, col, left, right``: share of the seconds in which a team owned a cell; cells never owned are left out."""
    owned = territory(p, lines, first, cells=True)
    cell = owned.select("match_id", F.posexplode("owners").alias("cell", "owner")).where("owner <> 0")
    sums = cell.groupBy("match_id", "cell").agg(F.count_if(F.col("owner") == 1).alias("l"), F.count_if(F.col("owner") == -1).alias("r"))
    seconds = catalog.select("match_id", (F.floor((F.col("last_frame") - F.col("first_frame")) / FPS) + 1).alias("s"))
    return sums.join(seconds, "match_id").select("match_id", F.floor(F.col("cell") / 21).alias("row"), (F.col("cell") % 21).cast("bigint").alias("col"), F.round(F.col("l") / F.col("s"), 3).alias("left"), F.round(F.col("r") / F.col("s"), 3).alias("right"))


def shape_average(seconds: DataFrame) -> DataFrame:
    """``match_id, team, seconds, ...``: plain means of the unrounded values of a team's seconds."""
    return seconds.groupBy("match_id", "team").agg(F.count("*").alias("seconds"), *[F.avg(c).alias(c) for c in ("x", "y", "width", "length", "hull_area", "defensive_line", "compactness")])

"""Analytics of recordings: clean lines, steps, sprints, shapes, grids, smoothing.

Every function takes DataFrames and returns one; names of the key columns are parameters
where the operator also serves other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.functions.geometry import HALF_LENGTH, HALF_WIDTH, cell, distance, finite_pair

FPS = 25
MAX_STEP_GAP = 5
PLAYER_CAP, BALL_CAP = 12.0, 40.0
SPRINT_SPEED, SPRINT_SECONDS = 7.0, 1.0
SMOOTH_HALF = 6
TRACK = ("match_id", "id")


def newest_lines(frames: DataFrame) -> DataFrame:
    """The line with the largest ``line_no`` of every (match_id, frame)."""
    rank = F.row_number().over(Window.partitionBy("match_id", "frame").orderBy(F.desc("line_no")))
    return frames.where(F.col("frame").isNotNull() & F.col("match_id").isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def people(lines: DataFrame) -> DataFrame:
    """``match_id, frame, pos, id, role, team, jersey, box, x, y``: first entry of each id; x, y null unless usable."""
    p = F.col("e.p")
    good = finite_pair(p["xy"])
    return _first_entries(lines).select(
        "match_id", "frame", F.col("e.pos").alias("pos"), p["id"].alias("id"), p["role"].alias("role"), p["team"].alias("team"), p["jersey"].alias("jersey"),
        p["box"].alias("box"), F.when(good, F.get(p["xy"], F.lit(0))).alias("x"), F.when(good, F.get(p["xy"], F.lit(1))).alias("y"))


def people_fields(frames: DataFrame, *fields: str) -> DataFrame:
    """``match_id, frame, id`` and some fields of the people of the newest lines: only these are read and shuffled."""
    slim = F.arrays_zip("people.id", *[f"people.{c}" for c in fields])
    lines = newest_lines(frames.select("match_id", "frame", "line_no", slim.alias("people")))
    return _first_entries(lines).select("match_id", "frame", *[F.col(f"e.p.{c}").alias(c) for c in ("id", *fields)])


def _first_entries(lines: DataFrame) -> DataFrame:
    """``match_id, frame, e`` (pos and the person p): first entry of each id of a line."""
    ids = F.col("people.id")
    first = F.filter(F.transform("people", lambda p, i: F.struct(i.alias("pos"), p.alias("p"))), lambda e: F.array_position(ids, e["p"]["id"]) == e["pos"] + 1)
    return lines.select("match_id", "frame", F.explode(first).alias("e")).where(F.col("e.p.id").isNotNull())


def balls(lines: DataFrame) -> DataFrame:
    """``match_id, frame, found, x, y``: x, y null unless the ball's position is usable."""
    good = finite_pair(F.col("ball.xy"))
    return lines.select("match_id", "frame", F.col("ball").isNotNull().alias("found"), F.when(good, F.get("ball.xy", F.lit(0))).alias("x"), F.when(good, F.get("ball.xy", F.lit(1))).alias("y"))


def positioned(p: DataFrame) -> DataFrame:
    """Rows with a position."""
    return p.where(F.col("x").isNotNull())


def steps(points: DataFrame, key: tuple[str, ...] = TRACK, order: str = "frame", cap: float = PLAYER_CAP, fps: int = FPS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, f0, f1, gap, d, t, v, counted`` of neighbouring points of a track (one window, no join)."""
    w = Window.partitionBy(*key).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    rows = points.select(*key, *keep, F.col(order).alias("f1"), before(order).alias("f0"), distance(before("x"), before("y"), F.col("x"), F.col("y")).alias("d"))
    gap = F.col("f1") - F.col("f0")
    rows = rows.where(F.col("f0").isNotNull()).withColumn("gap", gap).withColumn("t", F.col("gap") / F.lit(float(fps))).withColumn("v", F.try_divide("d", "t"))
    return rows.withColumn("counted", (F.col("gap") <= MAX_STEP_GAP) & (F.col("v") <= cap))


def sprint_runs(step: DataFrame, key: tuple[str, ...] = TRACK, fps: int = FPS, speed: float = SPRINT_SPEED, seconds: float = SPRINT_SECONDS) -> DataFrame:
    """``key, start_frame, end_frame, gap, distance_m, max_speed``: fast runs of at least the sprint time."""
    w = Window.partitionBy(*key).orderBy("f1")
    fast = F.col("counted") & (F.col("v") >= speed)
    run = F.sum(F.when(fast, 0).otherwise(1)).over(w)
    return (step.withColumn("_run", run).where(fast).groupBy(*key, "_run")
            .agg(F.min("f0").alias("start_frame"), F.max("f1").alias("end_frame"), F.sum("gap").alias("gap"), F.sum("d").alias("distance_m"), F.max("v").alias("max_speed"))
            .where(F.col("gap") / fps >= seconds - 1e-9).drop("_run"))


def player_summary(p: DataFrame, key: tuple[str, ...] = TRACK, fps: int = FPS) -> DataFrame:
    """``key, role, team, jersey, frames, seconds, distance_m, avg_speed_ms, max_speed_ms, sprints`` of every track."""
    who = p.groupBy(*key).agg(F.mode("role", True).alias("role"), F.mode("team", True).alias("team"), F.mode("jersey", True).alias("jersey"), F.count("*").alias("frames"))
    step = steps(positioned(p), key, fps=fps)
    counted = lambda c: F.when(F.col("counted"), F.col(c))
    moved = step.groupBy(*key).agg(F.sum(counted("d")).alias("d"), F.sum(counted("gap")).alias("g"), F.max(counted("v")).alias("v"))
    runs = sprint_runs(step, key, fps).groupBy(*key).agg(F.count("*").alias("s"))
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return (who.join(moved, [*key], "left").join(runs, [*key], "left")
            .select(*key, "role", "team", "jersey", "frames", (F.col("frames") / F.lit(float(fps))).alias("seconds"), zero(F.col("d"), "distance_m"),
                    zero(F.try_divide("d", F.col("g") / F.lit(float(fps))), "avg_speed_ms"), zero(F.col("v"), "max_speed_ms"), F.coalesce("s", F.lit(0)).alias("sprints")))


def segments(points: DataFrame, key: tuple[str, ...] = TRACK, order: str = "frame", gap: int = MAX_STEP_GAP) -> DataFrame:
    """The points with ``segment``: a new one after every gap of more than ``gap``."""
    w = Window.partitionBy(*key).orderBy(order)
    return points.withColumn("segment", F.sum(F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)).over(w))


def smoothed(points: DataFrame, key: tuple[str, ...] = TRACK, half: int = SMOOTH_HALF) -> DataFrame:
    """``key, frame, x, y`` with jitter taken out: running medians of the displacements, summed from each segment's first point.

    The last point of a track and tracks with fewer than three appearances stay as they are.
    """
    seg = segments(points, key)
    inside = Window.partitionBy(*key, "segment").orderBy("frame")
    near = inside.rowsBetween(-half, half)
    moved = seg.select("*", (F.col("x") - F.lag("x").over(inside)).alias("_dx"), (F.col("y") - F.lag("y").over(inside)).alias("_dy"))
    median = lambda c: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(F.percentile(c, F.lit(0.5)).over(near))
    medians = moved.select("*", median("_dx").alias("_mx"), median("_dy").alias("_my"))
    track = Window.partitionBy(*key)
    last = F.lead("frame").over(Window.partitionBy(*key).orderBy("frame")).isNull()
    anchor = lambda c: F.first(c).over(inside)
    total = lambda c: F.sum(c).over(inside)
    raw = last | (F.count("*").over(track) < 3)
    return medians.select(*key, "frame", F.when(raw, F.col("x")).otherwise(anchor("x") + total("_mx")).alias("x"), F.when(raw, F.col("y")).otherwise(anchor("y") + total("_my")).alias("y"))


def moving_average(points: DataFrame, span: int = 5, gap: int = 8, key: tuple[str, ...] = TRACK) -> DataFrame:
    """``key, frame, x, y``: mean of the points within ``span`` frames, across no gap above ``gap``; end points of a segment stay."""
    seg = segments(points, key, gap=gap)
    inside = Window.partitionBy(*key, "segment").orderBy("frame")
    near = inside.rangeBetween(-span, span)
    end = F.lag("frame").over(inside).isNull() | F.lead("frame").over(inside).isNull()
    return seg.select(*key, "frame", *[F.when(end, F.col(c)).otherwise(F.avg(c).over(near)).alias(c) for c in ("x", "y")])


def gap_filled(points: DataFrame, longest: int, key: tuple[str, ...] = TRACK, order: str = "frame") -> DataFrame:
    """``key, order, x, y, filled``: the points and, in gaps of at most ``longest``, points between by straight line."""
    w = Window.partitionBy(*key).orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    pairs = points.select(*key, order, "x", "y", nxt(order).alias("_f"), nxt("x").alias("_x"), nxt("y").alias("_y"))
    end = F.when((F.col("_f") - F.col(order)).between(2, longest), F.col("_f") - 1).otherwise(F.col(order))
    rows = pairs.select("*", F.explode(F.sequence(F.col(order), end)).alias("_at"))
    share = (F.col("_at") - F.col(order)) / (F.col("_f") - F.col(order))
    at = lambda c: F.when(F.col("_at") == F.col(order), F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * share).alias(c)
    return rows.select(*key, F.col("_at").alias("_o"), at("x"), at("y"), (F.col("_at") != F.col(order)).alias("filled")).withColumnRenamed("_o", order)


def occupancy(points: DataFrame, by: list[str], nx: int = 21, ny: int = 14) -> DataFrame:
    """``by, row, col, n``: positions per grid cell, outside dropped (dense only at an output boundary)."""
    col, row = cell(F.col("x"), -HALF_LENGTH, 2 * HALF_LENGTH, nx), cell(F.col("y"), -HALF_WIDTH, 2 * HALF_WIDTH, ny)
    return points.select(*by, row.alias("row"), col.alias("col")).where("row is not null and col is not null").groupBy(*by, "row", "col").agg(F.count("*").alias("n"))


def dense_grid(counts: DataFrame, by: list[str], nx: int = 21, ny: int = 14) -> DataFrame:
    """All nx x ny cells of every group, 0 where none was counted."""
    cells = counts.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("row")).select(*by, "row", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("col"))
    return cells.join(counts, [*by, "row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def team_shape(p: DataFrame, least: int = 3) -> DataFrame:
    """``match_id, team, frames, x, y, width, length``: means over the frames with enough positioned players."""
    frame = (positioned(p).where((F.col("role") == "player") & F.col("team").isin("left", "right")).groupBy("match_id", "team", "frame")
             .agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), (F.max("y") - F.min("y")).alias("width"), (F.max("x") - F.min("x")).alias("length")))
    return frame.where(F.col("n") >= least).groupBy("match_id", "team").agg(F.count("*").alias("frames"), *[F.avg(c).alias(c) for c in ("x", "y", "width", "length")])


def catalog(lines: DataFrame, fps: int = FPS) -> DataFrame:
    """``match_id, frame_count, first_frame, last_frame, duration_s, delay, colors``: one row a recording."""
    return lines.groupBy("match_id").agg(
        F.count("*").alias("frame_count"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        ((F.max("frame") - F.min("frame") + 1) / F.lit(float(fps))).alias("duration_s"), F.coalesce(F.min_by("delay", "frame"), F.lit(0)).alias("delay"),
        F.max_by("colors", F.when(F.col("colors").isNotNull(), F.col("frame"))).alias("colors"))


def frame_slice(lines: DataFrame, match_id: str, start: int, end: int, step: int = 1) -> DataFrame:
    """Every ``step``-th of the selected lines of one recording, with the number selected in ``total``."""
    w = Window.partitionBy("match_id")
    chosen = lines.where((F.col("match_id") == match_id) & F.col("frame").between(start, end))
    return chosen.withColumn("total", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("frame"))).where((F.col("_n") - 1) % step == 0).drop("_n")


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """Left rows with the ``values`` of the last right row of the key whose ``since`` is not after ``at`` (null if none).

    A union and one window: no range join, and right rows need not be collected.
    """
    names = left.columns
    a = left.select(*[F.col(c).alias(f"_l_{c}") for c in names], *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(at).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values], F.lit(None).cast("boolean").alias("_has"))
    b = right.select(*[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in names], *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(since).alias("_at"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_v_{v}") for v in values], F.lit(True).alias("_has"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.struct(*[F.col(f"_v_{v}").alias(v) for v in values])
    both = a.unionByName(b).withColumn("_held", F.last(F.when(F.col("_has"), held), True).over(w)).where("_side = 1")
    return both.select(*[F.col(f"_l_{c}").alias(c) for c in names], *[F.col("_held")[v].alias(v) for v in values])


def near_in_range(left: DataFrame, right: DataFrame, key: list[str], at: str, since: str, reach: int, close: Column) -> DataFrame:
    """Left rows for which some right row has ``since`` in [at - reach, at] and meets ``close`` (a condition on aliases a, b).

    An interval semi join as an equi join: both sides go to buckets of ``reach`` + 1, the right
    side also to the next bucket, so a match shares exactly one bucket.
    """
    size = reach + 1
    a = left.withColumn("_bucket", F.floor(F.col(at) / size)).alias("a")
    b = right.withColumn("_bucket", F.explode(F.array(F.floor(F.col(since) / size), F.floor(F.col(since) / size) + 1))).alias("b")
    on = F.col("a._bucket") == F.col("b._bucket")
    for k in key:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on & (F.col(f"b.{since}") <= F.col(f"a.{at}")) & (F.col(f"b.{since}") >= F.col(f"a.{at}") - reach) & close, "left_semi").drop("_bucket")


def trails(p: DataFrame, last: int = 20) -> DataFrame:
    """``match_id, id, frame, trail``: the last positions of an id seen in lines without a break."""
    lines = Window.partitionBy("match_id").orderBy("frame")
    numbered = p.join(p.select("match_id", "frame").distinct().withColumn("_line", F.row_number().over(lines)), ["match_id", "frame"])
    w = Window.partitionBy("match_id", "id").orderBy("frame")
    visible = numbered.withColumn("_island", F.col("_line") - F.row_number().over(w))
    near = Window.partitionBy("match_id", "id", "_island").orderBy("frame").rowsBetween(-(last - 1), 0)
    return visible.select("match_id", "id", "frame", F.collect_list(F.struct("x", "y")).over(near).alias("trail"))


def roster(p: DataFrame) -> DataFrame:
    """``match_id, team, jersey, last_frame, number``: who was seen, referees left out; ``number`` orders jerseys by value."""
    return (p.where((F.col("role") != "referee") & F.col("jersey").isNotNull() & F.col("team").isNotNull()).groupBy("match_id", "team", "jersey")
            .agg(F.max("frame").alias("last_frame")).withColumn("number", F.col("jersey").try_cast("int")))


def role_votes(p: DataFrame, window: int = 25, delay: int = 0, known: tuple[str, ...] = ("player", "goalkeeper", "referee", "other")) -> DataFrame:
    """``match_id, id, frame, role``: most common role in (frame - window, frame + delay]; ties to the role seen first on the track.

    One RANGE window per value of ``known``, so nothing is joined or collected; other values have no vote.
    """
    w = Window.partitionBy("match_id", "id").orderBy("frame")
    near = w.rangeBetween(-(window - 1), delay)
    said = p.where(F.col("role").isin(*known))
    best = F.greatest(*[F.struct(F.count(F.when(F.col("role") == r, 1)).over(near).alias("n"),
                                 (-F.coalesce(F.min(F.when(F.col("role") == r, F.col("frame"))).over(Window.partitionBy("match_id", "id")), F.lit(2**40))).alias("first"), F.lit(r).alias("r")) for r in known])
    return said.select("match_id", "id", "frame", best["r"].alias("role"))


def between_frames(p: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """``match_id, id, frame, x, y``: people a share ``t`` of the way from each line to the next, of those in both.

    Where one of the two has no position, the first line's stands.
    """
    t = min(1.0, max(0.0, t))
    following = lines.select("match_id", "frame", F.lead("frame").over(Window.partitionBy("match_id").orderBy("frame")).alias("_next"))
    w = Window.partitionBy("match_id", "id").orderBy("frame")
    pairs = p.select("match_id", "id", "frame", "x", "y", *[F.lead(c).over(w).alias(f"_{c}") for c in ("frame", "x", "y")])
    both = pairs.join(following, ["match_id", "frame"]).where("_frame = _next")
    at = lambda c: F.when(F.col("x").isNull() | F.col("_x").isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * t).alias(c)
    return both.select("match_id", "id", "frame", at("x"), at("y"))

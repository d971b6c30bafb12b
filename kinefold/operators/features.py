"""Match features: possession, events, intensity, territory, shape, formation, quality, comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.functions.geometry import distance, hull_area
from kinefold.operators.recording import FPS, near_in_range, player_summary, positioned, sprint_runs, steps

REACH, HOLD_S = 3.0, 0.5
PEAK_SPEED, LONG_DISTANCE, LONG_WINDOW = 15.0, 25.0, 50
TEAMS = ("left", "right")
PLAYING = ("player", "goalkeeper")


def _playing(p: DataFrame) -> DataFrame:
    return positioned(p).where(F.col("role").isin(*PLAYING) & F.col("team").isin(*TEAMS))


def raw_owner(p: DataFrame, ball: DataFrame) -> DataFrame:
    """``match_id, frame, owner``: team of the nearest player within reach, none at a tie or without ball; one row per line."""
    d = distance(F.col("bx"), F.col("by"), F.col("x"), F.col("y"))
    b = ball.select("match_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    near = (_playing(p).join(b.where("bx is not null"), ["match_id", "frame"]).groupBy("match_id", "frame")
            .agg(*[F.min(F.when(F.col("team") == t, d)).alias(t) for t in TEAMS]))
    owner = (F.when(F.coalesce(F.col("left") == F.col("right"), F.lit(False)), "none").when(F.least("left", "right") > REACH, "none")
             .when(F.col("right").isNull() | (F.col("left") < F.col("right")), "left").otherwise("right"))
    return b.select("match_id", "frame").join(near, ["match_id", "frame"], "left").select("match_id", "frame", F.when(F.col("left").isNull() & F.col("right").isNull(), "none").otherwise(owner).alias("owner"))


def _islands(rows: DataFrame, value: str, key: str = "match_id", order: str = "frame") -> DataFrame:
    """Runs of equal ``value`` over consecutive numbers of ``order``: ``key, value, start, end, n``."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(key, value).orderBy(order))
    return rows.withColumn("_i", island).groupBy(key, value, "_i").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_i")


def possession_timeline(owners: DataFrame) -> DataFrame:
    """``match_id, owner, start_frame, end_frame``: team runs held long enough, all else none; equal neighbours joined."""
    runs = _islands(owners, "owner")
    final = runs.withColumn("owner", F.when((F.col("owner") != "none") & ((F.col("n") - 1) / F.lit(float(FPS)) < HOLD_S), "none").otherwise(F.col("owner")))
    w = Window.partitionBy("match_id").orderBy("start")
    fresh = F.when((F.lag("owner").over(w) == F.col("owner")) & (F.lag("end").over(w) + 1 == F.col("start")), 0).otherwise(1)
    joined = final.withColumn("_n", fresh).withColumn("_r", F.sum("_n").over(w))
    return joined.groupBy("match_id", "owner", "_r").agg(F.min("start").alias("start_frame"), F.max("end").alias("end_frame")).drop("_r")


def possession_counts(timeline: DataFrame) -> DataFrame:
    """``match_id, owner, frames``: frames by owner (percentages are a ratio of these)."""
    return timeline.groupBy("match_id", "owner").agg(F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames"))


def possession_windows(timeline: DataFrame, first: DataFrame, length: int = 7500) -> DataFrame:
    """``match_id, window, left, right, none``: frames by owner in windows of ``length`` frames from the first."""
    t = timeline.join(first, "match_id").select("match_id", "owner", (F.col("start_frame") - F.col("first_frame")).alias("a"), (F.col("end_frame") - F.col("first_frame")).alias("b"))
    parts = t.select("*", F.explode(F.sequence(F.floor(F.col("a") / length), F.floor(F.col("b") / length))).alias("window"))
    n = F.least("b", F.col("window") * length + length - 1) - F.greatest("a", F.col("window") * length) + 1
    return parts.withColumn("n", n).groupBy("match_id", "window").agg(*[F.sum(F.when(F.col("owner") == o, F.col("n")).otherwise(0)).alias(o) for o in (*TEAMS, "none")])


def ball_peaks(ball: DataFrame, least: float = PEAK_SPEED) -> DataFrame:
    """``match_id, frame, speed``: one event per run of fast ball samples, at its first highest."""
    s = steps(ball.where("x is not null"), ("match_id",), cap=float("inf"))
    w = Window.partitionBy("match_id").orderBy("f1")
    runs = s.withColumn("_r", F.sum(F.when(F.col("v") > least, 0).otherwise(1)).over(w)).where(F.col("v") > least)
    top = F.max(F.struct(F.col("v"), (-F.col("f1")).alias("f")))
    return runs.groupBy("match_id", "_r").agg(top.alias("t")).select("match_id", (-F.col("t.f")).alias("frame"), F.col("t.v").alias("speed"))


def long_balls(ball: DataFrame, least: float = LONG_DISTANCE, window: int = LONG_WINDOW) -> DataFrame:
    """``match_id, frame, distance``: runs of observations far from where the ball was ``window`` frames ago or later."""
    w = Window.partitionBy("match_id").orderBy("frame")
    since = w.rangeBetween(-window, 0)
    seen = ball.where("x is not null").select("match_id", "frame", distance(F.first("x").over(since), F.first("y").over(since), F.col("x"), F.col("y")).alias("d"))
    runs = seen.withColumn("_r", F.sum(F.when(F.col("d") > least, 0).otherwise(1)).over(w)).where(F.col("d") > least)
    return runs.groupBy("match_id", "_r").agg(F.min("frame").alias("frame"), F.max("d").alias("distance")).drop("_r")


def nearest_owner(p: DataFrame, ball: DataFrame) -> DataFrame:
    """``match_id, frame, id, team``: nearest player of a team to the ball at any distance, ties to the smaller id."""
    d = distance(F.col("bx"), F.col("by"), F.col("x"), F.col("y"))
    b = ball.where("x is not null").select("match_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    best = F.min(F.struct(d.alias("d"), "id", "team"))
    return _playing(p).join(b, ["match_id", "frame"]).groupBy("match_id", "frame").agg(best.alias("o")).select("match_id", "frame", "o.id", "o.team")


def possession_changes(owners: DataFrame) -> DataFrame:
    """``match_id, frame, id, team, from_team``: owned frames whose team differs from that of the last owned frame."""
    w = Window.partitionBy("match_id").orderBy("frame")
    return owners.withColumn("from_team", F.lag("team").over(w)).where(F.col("from_team") != F.col("team"))


def sprint_events(p: DataFrame) -> DataFrame:
    """``match_id, frame, id, team, speed, distance, duration``: sprints of players and keepers, at their last frame."""
    who = positioned(p).where(F.col("role").isin(*PLAYING))
    runs = sprint_runs(steps(who))
    team = who.select("match_id", "id", F.col("frame").alias("end_frame"), F.when(F.col("team").isin(*TEAMS), F.col("team")).alias("team"))
    return runs.join(team, ["match_id", "id", "end_frame"]).select("match_id", F.col("end_frame").alias("frame"), "id", "team", F.col("max_speed").alias("speed"), F.col("distance_m").alias("distance"), (F.col("gap") / F.lit(float(FPS))).alias("duration"))


def match_events(p: DataFrame, ball: DataFrame) -> DataFrame:
    """``match_id, frame, type, id, team, from_team, speed, distance, duration``: the four kinds of events in one stream."""
    kinds = {"ball_speed_peak": ball_peaks(ball), "long_ball": long_balls(ball), "possession_change": possession_changes(nearest_owner(p, ball)), "sprint": sprint_events(p)}
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("type", F.lit(k)) for k, df in kinds.items()])
    return whole.select("match_id", "frame", "type", "id", "team", "from_team", "speed", "distance", "duration")


def zone(v: Column) -> Column:
    """Speed zone of a step."""
    return F.when(v < 2, "walk").when(v < 4, "jog").when(v < 6, "run").when(v < 7, "high").otherwise("sprint")


def counted_people(p: DataFrame) -> DataFrame:
    """``match_id, id, team, jersey`` of the tracks whose usual role and team take part."""
    who = p.groupBy("match_id", "id").agg(F.mode("role", True).alias("role"), F.mode("team", True).alias("team"), F.mode("jersey", True).alias("jersey"))
    return who.where(F.col("role").isin(*PLAYING) & F.col("team").isin(*TEAMS)).drop("role")


def intensity(p: DataFrame, first: DataFrame, value: Column | None = None) -> DataFrame:
    """``match_id, team, id, minute, zone, distance``: sums per level (null id: the team; null minute: the match).

    Grouping sets build players, teams, minutes and totals from one pass over the steps.
    ``value`` replaces the step length that is summed (for exact integer sums).
    """
    s = steps(positioned(p)).where("counted").join(counted_people(p), ["match_id", "id"]).join(first, "match_id")
    rows = s.select("match_id", "team", "id", F.floor((F.col("f0") - F.col("first_frame")) / 1500).alias("minute"), zone(F.col("v")).alias("zone"), (value if value is not None else F.col("d")).alias("d"))
    sets = [[F.col(c) for c in g] for g in (("match_id", "team", "id", "minute", "zone"), ("match_id", "team", "id", "zone"), ("match_id", "team", "minute", "zone"), ("match_id", "team", "zone"))]
    return rows.groupingSets(sets, "match_id", "team", "id", "minute", "zone").agg(F.sum("d").alias("distance"))


def work_rate(p: DataFrame, catalog: DataFrame) -> DataFrame:
    """``match_id, team, id, distance, metres_per_minute`` of counted people."""
    s = steps(positioned(p)).where("counted").groupBy("match_id", "id").agg(F.sum("d").alias("distance"))
    rows = counted_people(p).join(s, ["match_id", "id"], "left").join(catalog.select("match_id", "duration_s"), "match_id")
    d = F.coalesce("distance", F.lit(0.0))
    return rows.select("match_id", "team", "id", d.alias("distance"), (d / (F.col("duration_s") / 60)).alias("metres_per_minute"))


def territory(p: DataFrame, lines: DataFrame, first: DataFrame, nx: int = 21, ny: int = 14, cells: bool = False) -> DataFrame:
    """``match_id, second, left, right, cells``: cells owned by a team in more than half of a second's lines.

    With ``cells`` also ``owners``: 1 (left), -1 (right) or 0 for every cell, row by row.

    A second holds at most 25 lines of some two dozen people, so its positions fit a row; the
    grid is laid over them in Arrow batches with array arithmetic instead of a join with the cells.
    """
    second = F.floor((F.col("frame") - F.col("first_frame")) / FPS).alias("second")
    size = lines.join(first, "match_id").groupBy("match_id", second).agg(F.count("*").alias("b"))
    spots = (_playing(p).join(first, "match_id").groupBy("match_id", second)
             .agg(F.collect_list(F.struct("frame", (F.col("team") == "left").cast("int").alias("side"), "x", "y")).alias("s")))
    rows = spots.join(size, ["match_id", "second"]).select(
        "match_id", "second", "b", F.col("s.frame").alias("f"), F.col("s.side").alias("t"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, r = np.meshgrid(np.arange(nx), np.arange(ny))
        cx, cy = (-52.5 + (c + 0.5) * (105.0 / nx)).ravel(), (-34.0 + (r + 0.5) * (68.0 / ny)).ravel()
        for batch in batches:
            out = []
            for b, f, t, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                f, t, x, y = (np.asarray(v) for v in (f, t, x, y))
                order = np.lexsort((t, f))
                f, t, x, y = f[order], t[order], x[order], y[order]
                d = (x[:, None] - cx) ** 2 + (y[:, None] - cy) ** 2
                head = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (t[1:] != t[:-1])))
                near = np.minimum.reduceat(d, head, axis=0)
                _, frame = np.unique(f[head], return_inverse=True)
                best = np.full((2, frame.max() + 1, nx * ny), np.inf)
                best[t[head], frame] = near
                left, right = 2 * (best[1] < best[0]).sum(axis=0) > b, 2 * (best[0] < best[1]).sum(axis=0) > b
                out.append((int(left.sum()), int(right.sum()), nx * ny, (left.astype(np.int8) - right).tolist() if cells else None))
            *columns, owners = list(zip(*out)) if out else [[]] * 4
            arrays = [batch.column(0), batch.column(1), *[pa.array([*v], type=pa.int64()) for v in columns]]
            if cells:
                arrays.append(pa.array([*owners], type=pa.list_(pa.int8())))
            yield pa.RecordBatch.from_arrays(arrays, names=["match_id", "second", "left", "right", "cells", *(["owners"] if cells else [])])

    return rows.mapInArrow(own, "match_id string, second bigint, left bigint, right bigint, cells bigint" + (", owners array<tinyint>" if cells else ""))


def shape_by_second(p: DataFrame, first: DataFrame, least: int = 4, exact: bool = False) -> DataFrame:
    """``match_id, team, second, players, x, y, width, length, hull_area, defensive_line, compactness``.

    ``exact`` averages whole millimetres, which does not depend on the order of the rows.
    """
    who = positioned(p).where((F.col("role") == "player") & F.col("team").isin(*TEAMS)).join(first, "match_id")
    second = F.floor((F.col("frame") - F.col("first_frame")) / FPS)
    mean = (lambda c: F.sum(F.round(F.col(c) * 1000).cast("bigint")) / F.count("*") / 1000) if exact else (lambda c: F.avg(c))
    spot = who.groupBy("match_id", "team", second.alias("second"), "id").agg(mean("x").alias("x"), mean("y").alias("y"), F.min(F.struct("frame", "pos")).alias("seen"))
    depth = F.when(F.col("team") == "left", F.col("x")).otherwise(-F.col("x"))
    deep = F.row_number().over(Window.partitionBy("match_id", "team", "second").orderBy(depth, "seen"))
    whole = Window.partitionBy("match_id", "team", "second")
    ranked = (spot.withColumn("_deep", deep).withColumn("_cx", F.avg("x").over(whole)).withColumn("_cy", F.avg("y").over(whole))
              .withColumnsRenamed({"x": "_x", "y": "_y"}))
    spots = F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    return ranked.groupBy("match_id", "team", "second").agg(
        F.count("*").alias("players"), F.avg("_x").alias("x"), F.avg("_y").alias("y"), (F.max("_y") - F.min("_y")).alias("width"), (F.max("_x") - F.min("_x")).alias("length"),
        hull_area(spots).alias("hull_area"),
        F.abs(F.avg(F.when(F.col("_deep") <= 4, F.col("_x"))) - F.when(F.col("team") == "left", -52.5).otherwise(52.5)).alias("defensive_line"),
        F.avg(distance(F.col("_cx"), F.col("_cy"), F.col("_x"), F.col("_y"))).alias("compactness")).where(F.col("players") >= least)


def formations(p: DataFrame, lines: DataFrame, first: DataFrame, window: int = 1500, gap: float = 10.0) -> DataFrame:
    """``match_id, window, team, players, formation, coverage, tightness, confidence`` per window of frames."""
    which = F.floor((F.col("frame") - F.col("first_frame")) / window)
    total = lines.join(first, "match_id").groupBy("match_id", which.alias("window")).agg(F.count("*").alias("total"))
    seen = positioned(p).where((F.col("role") == "player") & F.col("team").isin(*TEAMS)).join(first, "match_id").withColumn("window", which)
    ok = seen.groupBy("match_id", "window", "team", "frame").agg(F.count("*").alias("n")).where("n >= 3").groupBy("match_id", "window", "team").agg(F.count("*").alias("ok"))
    depth = F.when(F.col("team") == "left", F.avg("x") + 52.5).otherwise(52.5 - F.avg("x"))
    mean = seen.groupBy("match_id", "window", "team", "id").agg(depth.alias("d"), F.avg("y").alias("y"), F.count("*").alias("n"))
    side = Window.partitionBy("match_id", "window", "team").orderBy("d", "id")
    line = mean.withColumn("_gap", F.col("d") - F.lag("d").over(side)).withColumn("line", F.sum(F.when(F.col("_gap") >= gap, 1).otherwise(0)).over(side))
    each = line.groupBy("match_id", "window", "team", "line").agg(F.count("*").alias("size"), F.greatest(F.lit(0.0), 1 - (F.max("d") - F.min("d")) / gap).alias("tight"))
    team = each.groupBy("match_id", "window", "team").agg(F.sum("size").alias("players"), F.array_sort(F.collect_list(F.struct("line", "size", "tight"))).alias("l"))
    out = team.join(total, ["match_id", "window"]).join(ok, ["match_id", "window", "team"], "left")
    enough = F.col("players") >= 3
    tight = F.aggregate("l", F.lit(1.0), lambda s, e: s * e["tight"])
    coverage = F.coalesce(F.col("ok"), F.lit(0)) / F.col("total")
    return out.select("match_id", "window", "team", "players", F.when(enough, F.array_join(F.transform("l", lambda e: e["size"].cast("string")), "-")).alias("formation"),
                      coverage.alias("coverage"), tight.alias("tightness"), F.when(enough, coverage * tight).otherwise(0.0).alias("confidence"))


def formation_seats(p: DataFrame, first: DataFrame, window: int = 1500, gap: float = 10.0) -> DataFrame:
    """``match_id, window, team, id, line, seat, n``: place of every player in the formation of a window."""
    seen = positioned(p).where((F.col("role") == "player") & F.col("team").isin(*TEAMS)).join(first, "match_id")
    depth = F.when(F.col("team") == "left", F.avg("x") + 52.5).otherwise(52.5 - F.avg("x"))
    which = F.floor((F.col("frame") - F.col("first_frame")) / window).alias("window")
    mean = seen.groupBy("match_id", which, "team", "id").agg(depth.alias("d"), F.avg("y").alias("y"), F.count("*").alias("n"))
    side = Window.partitionBy("match_id", "window", "team")
    step = F.col("d") - F.lag("d").over(side.orderBy("d", "id"))
    line = mean.withColumn("_gap", step).withColumn("line", F.sum(F.when(F.col("_gap") >= gap, 1).otherwise(0)).over(side.orderBy("d", "id")))
    across = F.when(F.col("team") == "left", -F.col("y")).otherwise(F.col("y"))
    seat = F.row_number().over(Window.partitionBy("match_id", "window", "team", "line").orderBy(across, "id")) - 1
    return line.select("match_id", "window", "team", "id", "line", seat.alias("seat"), "n")


def empty_ranges(p: DataFrame, lines: DataFrame) -> DataFrame:
    """``match_id, start, end, frames``: runs of consecutive lines without a tracked person."""
    seen = positioned(p).select("match_id", "frame").distinct()
    none = lines.select("match_id", "frame").join(seen, ["match_id", "frame"], "left_anti").withColumn("v", F.lit(0))
    return _islands(none, "v").select("match_id", "start", "end", F.col("n").alias("frames"))


def fragments(p: DataFrame, frames: int = 37, metres: float = 3.0) -> DataFrame:
    """``match_id, id``: tracks that begin shortly after and close to where another one ended."""
    track = positioned(p).groupBy("match_id", "id").agg(F.min(F.struct("frame", "x", "y")).alias("s"), F.max(F.struct("frame", "x", "y")).alias("e"))
    a = track.select("match_id", "id", F.col("s.frame").alias("start"), F.col("s.x").alias("sx"), F.col("s.y").alias("sy"))
    b = track.select("match_id", F.col("id").alias("other"), F.col("e.frame").alias("end"), F.col("e.x").alias("ex"), F.col("e.y").alias("ey"))
    close = (F.col("a.id") != F.col("b.other")) & (distance(F.col("b.ex"), F.col("b.ey"), F.col("a.sx"), F.col("a.sy")) <= metres)
    return near_in_range(a, b, ["match_id"], "start", "end", frames, close).select("match_id", "id")


def quality(p: DataFrame, lines: DataFrame, ball: DataFrame, long_range: int = 25) -> DataFrame:
    """``match_id`` with counts, percentages, grade and warnings of a recording."""
    tracked = positioned(p)
    per = tracked.groupBy("match_id", "frame").agg(F.count("*").alias("n"), F.count_if(F.col("team").isin(*TEAMS)).alias("t"), F.count_if(F.length(F.trim("jersey")) > 0).alias("j"))
    people_part = per.groupBy("match_id").agg(F.sum("n").alias("tracked"), F.sum("t").alias("teamed"), F.sum("j").alias("read"), F.count_if(F.col("n") >= 8).alias("good"))
    ball_part = ball.groupBy("match_id").agg(F.count("*").alias("frames"), F.count_if("found").alias("found"))
    gaps = empty_ranges(p, lines).groupBy("match_id").agg(F.count("*").alias("ranges"), F.count_if(F.col("frames") >= long_range).alias("long_ranges"),
                                                          F.array_sort(F.collect_list(F.struct("start", "end", "frames"))).alias("no_people_ranges"))
    frag = fragments(p).groupBy("match_id").agg(F.count("*").alias("fragments"))
    joined = ball_part.join(people_part, "match_id", "left").join(gaps, "match_id", "left").join(frag, "match_id", "left").na.fill(0)
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col(a), F.col(b)), F.lit(0.0)), 1)
    out = joined.select("*", pct("good", "frames").alias("good_pct"), pct("teamed", "tracked").alias("team_pct"), pct("read", "tracked").alias("jersey_pct"), pct("found", "frames").alias("ball_pct"))
    checks = [F.col("good_pct") >= 80, F.col("long_ranges") == 0, F.col("fragments") == 0, F.col("team_pct") >= 90, F.col("jersey_pct") >= 50, F.col("ball_pct") >= 50]
    score = reduce(lambda a, b: a + b, [c.cast("int") for c in checks])
    grade = F.when(score == 6, "A").when(score == 5, "B").when(score == 4, "C").otherwise("D")
    some = F.col("tracked") > 0
    none = F.transform(F.filter(F.coalesce("no_people_ranges", F.array()), lambda r: r["frames"] >= long_range),
                       lambda r: F.format_string("No tracked people in frames %d..%d (%d frames) - the camera may be uncalibrated.", r["start"], r["end"], r["frames"]))
    good = F.array_compact(F.array(F.when(~checks[0], F.format_string("Only %.1f%% of frames have 8 or more tracked people.", "good_pct"))))
    rest = F.array_compact(F.array(
        F.when(~checks[2], F.format_string("%d tracks start within 1.5 s and 3 m of a track that just ended (possible id switches).", "fragments")),
        F.when(some & ~checks[3], F.format_string("Only %.1f%% of tracked people are assigned to a team.", "team_pct")),
        F.when(some & ~checks[4], F.format_string("Jersey numbers were read on only %.1f%% of tracked people.", "jersey_pct")),
        F.when(~checks[5], F.format_string("The ball was found in only %.1f%% of frames.", "ball_pct"))))
    per_frame = F.round(F.col("tracked") / F.col("frames"), 1)
    return out.select("*", per_frame.alias("tracked_per_frame"), score.alias("score"), grade.alias("grade"), F.concat(good, none, rest).alias("warnings"))

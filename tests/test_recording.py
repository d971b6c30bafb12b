"""Worked examples of recording operators and features, and their odd input."""

import pytest
from pyspark.sql import functions as F

from kinefold.operators import features as feat
from kinefold.operators import recording as rec


def points(spark, rows):
    return spark.createDataFrame([("m", 1, f, float(x), float(y)) for f, x, y in rows], "match_id string, id bigint, frame bigint, x double, y double")


def test_steps_discard_long_gaps_and_impossible_speeds(spark):
    rows = rec.steps(points(spark, [(0, 0, 0), (5, 1, 0), (11, 1.5, 0), (16, 4, 0)])).orderBy("f1").collect()
    assert [r.counted for r in rows] == [True, False, False] and rows[0].v == 5.0


def test_sprint_needs_a_second(spark):
    fast = [(200 + k, 0.32 * k, 0) for k in range(26)]
    run = rec.sprint_runs(rec.steps(points(spark, fast))).collect()
    assert len(run) == 1 and run[0].end_frame == 225 and run[0].distance_m == pytest.approx(8.0)
    assert rec.sprint_runs(rec.steps(points(spark, fast[:25]))).count() == 0


def test_smoothing_removes_a_jump_and_keeps_a_steady_track(spark):
    steady = [(k, 0.1 * k, 0.0) for k in range(40)]
    out = {r.frame: r.x for r in rec.smoothed(points(spark, steady)).collect()}
    assert all(out[f] == pytest.approx(x) for f, x, _ in steady)
    jump = [(f, x + (5 if f == 20 else 0), y) for f, x, y in steady]
    assert {r.frame: r.x for r in rec.smoothed(points(spark, jump)).collect()}[20] == pytest.approx(2.0)


def test_heatmap_upper_border_belongs_to_the_last_cell(spark):
    got = {(r.row, r.col) for r in rec.occupancy(points(spark, [(0, 52.5, 34), (1, -52.5, -34), (2, 53, 0)]), ["match_id"]).collect()}
    assert got == {(13, 20), (0, 0)}


def test_as_of_and_interval_semi_join(spark):
    a = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t bigint")
    b = spark.createDataFrame([("k", 2, None), ("k", 4, 1.0), ("k", 6, 2.0)], "k string, s bigint, v double")
    assert {(r.k, r.t): r.v for r in rec.as_of(a, b, ["k"], "t", "s", ["v"]).collect()} == {("k", 5): 1.0, ("k", 1): None, ("z", 9): None}
    for reach in (0, 1, 3):
        got = {r.t for r in rec.near_in_range(a, b, ["k"], "t", "s", reach, F.lit(True)).collect()}
        assert got == {t for k, t in (("k", 5), ("k", 1), ("z", 9)) if any(k == "k" and t - reach <= s <= t for s in (2, 4, 6))}


def _owners(make_frames, spec):
    lines, ball = {}, {}
    for f, who in spec:
        x = {"left": 1.0, "right": 50.0, "none": 30.0}[who]
        lines["m", f] = [(1, x if who != "right" else 60, 0, "player", "left"), (2, 1.0 if who == "right" else 60, 0, "player", "right")]
        ball["m", f] = (0.0, 0.0)
    frames = rec.newest_lines(make_frames(lines, ball))
    return feat.possession_timeline(feat.raw_owner(rec.people(frames), rec.balls(frames))).orderBy("start_frame").collect()


def test_possession_is_held_half_a_second(make_frames):
    got = _owners(make_frames, [(f, "left") for f in range(14)] + [(f, "right") for f in range(14, 20)] + [(f, "none") for f in range(20, 25)])
    assert [(r.owner, r.start_frame, r.end_frame) for r in got] == [("left", 0, 13), ("none", 14, 24)]


def test_a_missing_frame_ends_a_run(make_frames):
    got = _owners(make_frames, [(f, "left") for f in (*range(7), *range(10, 17))])
    assert [(r.owner, r.start_frame, r.end_frame) for r in got] == [("none", 0, 6), ("none", 10, 16)]


def test_ball_events(make_frames):
    ball = {("m", f): (0.0 if f <= 99 else float(f - 99), 0.0) for f in range(150)}
    frames = rec.newest_lines(make_frames({k: [] for k in ball}, ball))
    long = feat.long_balls(rec.balls(frames)).collect()
    assert [(r.frame, r.distance) for r in long] == [(125, 50.0)]
    assert len(feat.ball_peaks(rec.balls(frames)).collect()) == 1


def test_territory_tie_line(make_frames):
    frames = rec.newest_lines(make_frames({("m", f): [(1, 0, 0, "player", "left"), (2, 10, 0, "player", "right")] for f in range(25)}))
    first = frames.groupBy("match_id").agg(F.min("frame").alias("first_frame"))
    got = feat.territory(rec.people(frames), frames, first).collect()
    assert [(r.second, r.left, r.right, r.cells) for r in got] == [(0, 154, 126, 294)]


def test_shape_of_a_square_and_a_diamond(make_frames):
    square = [(1, 0, -5), (2, 0, 5), (3, 10, -5), (4, 10, 5), (5, 5, 5)]
    frames = rec.newest_lines(make_frames({("m", 0): [(*p, "player", "left") for p in square] + [(k, x, y, "player", "right") for k, x, y in ((11, 20, 0), (12, 30, 0), (13, 25, 8), (14, 25, -8))]}))
    first = frames.groupBy("match_id").agg(F.min("frame").alias("first_frame"))
    got = {r.team: r for r in feat.shape_by_second(rec.people(frames), first).collect()}
    assert got["left"].hull_area == pytest.approx(100.0) and got["right"].hull_area == pytest.approx(80.0)
    assert got["right"].compactness == pytest.approx(6.5) and got["right"].defensive_line == pytest.approx(27.5)


def test_formation_442(make_frames):
    side = [(1, -50, 15), (2, -50, 5), (3, -50, -5), (4, -50, -15), (5, -30, 15), (6, -30, 5), (7, -30, -5), (8, -30, -15), (9, -10, 6), (10, -10, -6)]
    frames = rec.newest_lines(make_frames({("m", f): [(*p, "player", "left") for p in side] for f in range(10)}))
    first = frames.groupBy("match_id").agg(F.min("frame").alias("first_frame"))
    r = feat.formations(rec.people(frames), frames, first).first()
    assert (r.formation, r.players, r.confidence) == ("4-4-2", 10, 1.0)


def test_fragment_needs_time_and_place(make_frames):
    lines = {("m", 24): [(1, 10.0, 3.0)], ("m", 25): [(2, 11.6, 5.2), (3, 13.2, 5.4)], ("m", 62): [(4, 11.6, 5.2)], ("m", 63): [(5, 11.0, 3.0)]}
    p = rec.people(rec.newest_lines(make_frames(lines)))
    # 4 starts 37 frames after 2 ended at its place; 5 starts one frame after 4 ended, within three metres
    assert {r.id for r in feat.fragments(p).collect()} == {2, 3, 4, 5}  # 3 is near 2's end in the same frame


@pytest.mark.parametrize("op", [
    lambda f: rec.player_summary(rec.people(rec.newest_lines(f))), lambda f: rec.catalog(rec.newest_lines(f)), lambda f: rec.team_shape(rec.people(rec.newest_lines(f))),
    lambda f: feat.match_events(rec.people(rec.newest_lines(f)), rec.balls(rec.newest_lines(f))), lambda f: feat.quality(rec.people(rec.newest_lines(f)), rec.newest_lines(f), rec.balls(rec.newest_lines(f)))])
def test_features_of_nothing(op, make_frames):
    frames = make_frames({("m", 1): [(1, 0, 0)]})
    assert op(frames.limit(0)).count() == 0
    assert op(frames.select(*[F.lit(None).cast(t).alias(c) for c, t in frames.dtypes])).count() == 0


def test_whole_queries_drop_no_rows_and_no_metric(spark, make_frames, tmp_path):
    from kinefold.plans import recording_queries as queries

    far = {(m, f): [(1, 5000.0 if f == 3 else float(f), 1.0)] for m in ("a", "b") for f in range(7)}
    make_frames(far).write.parquet(str(tmp_path / "frames.parquet"))
    smooth, mean = queries.smoothed(spark, str(tmp_path)), queries.moving_average(spark, str(tmp_path))
    assert smooth.count() == mean.count() == 14
    got = {(r.match_id, r.frame): r.x_cm for r in mean.collect()}
    assert got["a", 3] == pytest.approx(501_800 / 7) and got["a", 0] == 0.0
    from kinefold.plans import report_queries
    assert "avg_distance_m" in {r["name"] for r in report_queries.comparison(spark, str(tmp_path)).collect()}

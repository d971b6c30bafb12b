"""Spikes, stops and trips, regular grid: planted cases, block borders, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinefold.operators.regular_grid import regular_seconds
from kinefold.operators.robust_pca import robust_pca
from kinefold.operators.spikes import position_spikes, spikes_in_block, summary_spikes, SpikeParams, SummaryParams
from kinefold.operators.stops import core_pings, stops_and_trips


def walk(seed=0, stops=((20, 20), (70, 15)), end=120, pace=5, sigma=0.1):
    """A track at 2 m/s that stands still in ``stops`` (start, length in s); returns frames, x, y."""
    rng = np.random.default_rng(seed)
    f = np.arange(0, end * 25, pace)
    t = f / 25
    moved = t.copy()
    for a, n in stops:
        moved -= np.clip(t - a, 0, n)
    s = moved * 2.0
    x = -40 + np.abs((s + 80) % 160 - 80)
    y = 10 * np.sin(s / 40)
    return f, np.round(x + rng.normal(0, sigma, len(f)), 2), np.round(y + rng.normal(0, sigma, len(f)), 2)


def lines_of(tracks, match="m"):
    by = {}
    for who, (f, x, y) in tracks.items():
        for a, b, c in zip(f, x, y):
            by.setdefault((match, int(a)), []).append((who, float(b), float(c)))
    return dict(sorted(by.items()))


def test_robust_pca_separates_planted_spikes():
    rng = np.random.default_rng(1)
    low = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 16))
    m = low + rng.normal(0, 0.05, low.shape)
    where = rng.random(m.shape) < 0.02
    m[where] += 8
    _, sparse, sigma = robust_pca(m, 2)
    assert (sparse[where] != 0).mean() > 0.98 and (sparse[~where] != 0).mean() < 0.02 and sigma < 0.2


def test_planted_leaps_are_found_and_nothing_else():
    f, x, y = walk()
    for k in (60, 150, 151, 152, 300):
        x[k] += 6
    track = np.zeros(len(f), dtype=int)
    leap, out = spikes_in_block(track, f, x, y, SpikeParams())
    assert set(np.flatnonzero(leap)) == {60, 150, 151, 152, 300} and not out.any()


@pytest.fixture(scope="module")
def dirty(make_frames):
    tracks = {k: walk(k) for k in range(1, 9)}
    f, x, y = tracks[3]
    x[100] = 300.0
    x[200:203] += 7
    y[240:260] = y[240]
    return make_frames(lines_of(tracks))


def test_spikes_do_not_depend_on_blocks(dirty):
    whole = {tuple(r) for r in position_spikes(dirty).collect()}
    parts = {tuple(r) for r in position_spikes(dirty, span=400, halo=250).collect()}
    assert whole == parts
    assert {(500, "range"), (1000, "leap"), (1005, "leap"), (1010, "leap")} <= {(r[2], r[3]) for r in whole}
    assert {r[2] for r in whole if r[3] == "frozen"} == set(range(1205, 1300, 5))


def test_stops_and_trips_of_known_walks(dirty):
    rows = [r for r in stops_and_trips(dirty).collect() if r.id == 1]
    kinds = [r.kind for r in sorted(rows, key=lambda r: r.start_frame)]
    assert kinds == ["trip", "stop", "trip", "stop", "trip"]
    stops = sorted((r.start_frame / 25, r.end_frame / 25) for r in rows if r.kind == "stop")
    for (a, b), (start, n) in zip(stops, ((20, 20), (70, 15))):
        assert abs(a - start) < 1.0 and abs(b - start - n) < 1.0


def test_stops_do_not_depend_on_blocks(dirty):
    key = lambda r: (r.id, r.kind, round(r.start_frame / 12), round(r.end_frame / 12))
    assert sorted(map(key, stops_and_trips(dirty).collect())) == sorted(map(key, stops_and_trips(dirty, span=700, halo=250).collect()))


def test_silence_ends_and_short_silence_does_not(make_frames):
    f, x, y = walk(stops=((5, 60),), end=70)
    keep = ~((f > 500) & (f < 700))
    one = stops_and_trips(make_frames(lines_of({1: (f[keep], x[keep], y[keep])}))).where("kind = 'stop'").count()
    keep = ~((f > 500) & (f < 800))
    two = stops_and_trips(make_frames(lines_of({1: (f[keep], x[keep], y[keep])}))).where("kind = 'stop'").count()
    assert (one, two) == (1, 2)


def test_regular_seconds_against_plain_python(make_frames):
    rng = np.random.default_rng(4)
    f = np.sort(rng.choice(3000, 200, replace=False))
    x = rng.normal(size=200).round(2)
    frames = make_frames(lines_of({5: (f, x, x)}))
    seen = {int(a) // 25 for a in f}
    for span in (7500, 100):
        rows = {r.sec_no: r for r in regular_seconds(frames, span=span).collect()}
        assert set(rows) == set(range(min(seen), max(seen) + 1))
        assert {s for s, r in rows.items() if r.status == "measured"} == seen
        for s, r in rows.items():
            before, after = f[f <= s * 25], f[f >= s * 25]
            if r.status == "filled":
                assert r.x == pytest.approx(np.interp(s * 25, f, x)) and after[0] - before[-1] <= 75
            if r.status == "missing":
                assert r.x is None and after[0] - before[-1] > 75


def test_newest_line_and_first_entry_hold(make_frames):
    frames = make_frames([(("m", 10), [(1, 1, 1)]), (("m", 10), [(1, 2, 2), (1, 9, 9), (None, 5, 5)]), (("m", 11), None), (("m", 12), []), (("m", 13), [(2, None, None)])])
    rows = regular_seconds(frames).collect()
    assert [(r.id, r.sec_no, r.x) for r in rows] == [(1, 0, 2.0)]


@pytest.mark.parametrize("op", [position_spikes, stops_and_trips, regular_seconds])
def test_empty_nulls_and_extra_columns(op, make_frames, spark):
    frames = make_frames({("m", 1): [(1, 0, 0)]})
    assert op(frames.limit(0)).count() == 0
    nulls = frames.select(*[F.lit(None).cast(t).alias(c) for c, t in frames.dtypes])
    assert op(nulls).count() == 0
    extra = frames.withColumn("id", F.lit("x")).withColumn("block", F.lit(3)).withColumn("x", F.lit(1)).withColumn("kind", F.lit("k"))
    assert op(extra).count() == op(frames).count()


def test_nan_and_infinite_positions_are_no_readings(make_frames):
    frames = make_frames({("m", k): [(1, v, 0.0)] for k, v in enumerate([float("nan"), float("inf"), -float("inf"), 1.0])})
    assert position_spikes(frames).count() == 0 and regular_seconds(frames).count() == 1


SUMMARY = "match_id string, id bigint, role string, team string, jersey string, frames bigint, seconds double, distance_m double, avg_speed_ms double, max_speed_ms double, sprints bigint, computed_at timestamp"


def test_false_summaries(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        seconds, avg = float(rng.uniform(50, 500)), float(rng.uniform(1, 3))
        rows.append(["m", i, None, None, None, 1, seconds, seconds * avg, avg, float(rng.uniform(5, 8)), 0, None])
    rows[3][9], rows[4][9], rows[5][7], rows[6][7], rows[7][8] = 60.0, -1.0, rows[5][7] * 5, -3.0, float("nan")
    for k in range(20, 28):
        rows[k][9] = 6.25
    df = spark.createDataFrame([*rows, *rows], SUMMARY)
    got = {(r.field.split(".")[1], r.id) for r in summary_spikes(df).collect()}
    assert got == {("max_speed_ms", 3), ("max_speed_ms", 4), ("distance_m", 5), ("distance_m", 6)} | {("max_speed_ms", k) for k in range(21, 28)}
    assert summary_spikes(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 4, 10, 15])
def test_leaps_in_short_tracks(make_frames, n):
    f = 5 * np.arange(n)
    for k in range(n):
        x, y = 0.2 * f / 5 - 20.0, np.full(n, 3.0) + 0.01 * (np.arange(n) % 3)
        assert position_spikes(make_frames(lines_of({1: (f, x, y)}))).count() == 0
        x[k] += 40.0
        got = {(r.frame, r.reason) for r in position_spikes(make_frames(lines_of({1: (f, x, y)}))).collect()}
        assert got == {(5 * k, "leap")}
        if n == 10 and k > 1:
            break


def test_leap_in_the_short_end_of_a_long_track(make_frames):
    f = 5 * np.arange(108)
    x, y = 0.1 * np.arange(108) - 20.0, np.full(108, 3.0) + 0.01 * (np.arange(108) % 3)
    x[103] += 40.0
    frames = make_frames(lines_of({1: (f, x, y)}))
    for halo in (0, 25):
        assert {(r.frame, r.reason) for r in position_spikes(frames, span=500, halo=halo).collect()} == {(515, "leap")}


def test_short_tracks_without_a_majority_are_left_alone(make_frames):
    f = 5 * np.arange(4)
    x = np.array([-20.0, 20.0, -20.0, 20.0])
    assert position_spikes(make_frames(lines_of({1: (f, x, 0 * x), 2: (f[:2], x[:2], 0 * x[:2]), 3: (f[:1], x[:1], x[:1])}))).count() == 0


def test_false_summaries_are_judged_against_the_whole_match(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(205):
        seconds, avg = float(rng.uniform(50, 500)), float(rng.uniform(1, 3))
        rows.append(["m", i, None, None, None, 1, seconds, seconds * avg, avg, float(rng.uniform(5, 6)), 0, None])
    for i in (50, 203):
        rows[i][9] = 11.5 + i / 1000
    df = spark.createDataFrame(rows, SUMMARY)
    for size in (4096, 100):
        got = {(r.field.split(".")[1], r.id) for r in summary_spikes(df, SummaryParams(ids_per_block=size)).collect()}
        assert got == {("max_speed_ms", i) for i in (50, 203)}


def test_density_of_a_core_is_the_parameter():
    t = np.arange(0, 10, 0.5)
    x = np.where(np.arange(20) % 4 == 1, 5.0, 0.0)
    args = np.zeros(20, dtype=int), t, x, 0 * x, np.full(20, 0.9), 3.0
    assert core_pings(*args, 0.7)[x == 0].all() and not core_pings(*args, 0.9)[6:14].any()

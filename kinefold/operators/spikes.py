"""Implausible values per source: leaps, frozen values, impossible ranges (problem 1).

Positions: per block (source x stretch of time) the readings of every track are cut into
profiles of ``width`` readings; robust principal components split the profile matrix of the
source into low-rank normal movement and sparse spikes.  Sparse entries are candidates, and
an exact test against the track's course before and after decides.  Tracks too short for a
profile are tested reading by reading against their longest course.  Constant runs and ranges
are tested apart.  Summaries: the same split on the player profiles of a source decides on top
speeds, and on distances without a known average speed; the other distances are tested apart,
against seconds x average speed and the range.

Defined results: empty tables give no rows; rows without source, order key or id belong to
nothing and are left out; null, NaN and infinite values are never flagged; repeated
deliveries of a summary count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinefold.operators.blocks import HALO, SPAN, block_readings, line_blocks, usable
from kinefold.operators.robust_pca import MAD_TO_SIGMA, detrend, longest_course, off_course, profile_windows, robust_pca, scatter_by_track

LEAP, RANGE, FROZEN = "leap", "range", "frozen"

_MARKS = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("nth", pa.int32()),
                    ("value", pa.float64()), ("places", pa.list_(pa.int64()))])
_MARKS_DDL = "match_id string, id bigint, part int, block bigint, nth int, value double, places array<bigint>"
#: ``part`` of a mark: flagged places of one kind, or (0, 1) a border piece of the value runs of one column.
_PART = {LEAP: -1, RANGE: -2, FROZEN: -3}


@dataclass(frozen=True)
class SpikeParams:
    """Thresholds of the position test, in metres and seconds."""

    half_length: float = 52.5
    half_width: float = 34.0
    margin: float = 5.0        # beyond the lines by more than this cannot be
    width: int = 16            # readings in a profile
    rank: int = 3
    floor: float = 1.5         # a leap is at least this far off
    sigmas: float = 7.0        # ... and this many scatters
    push: float = 6.0          # acceleration that explains a turn, m/s2
    pace: float = 12.0         # top running speed, m/s
    reach: float = 10.0        # readings further away in time are no course
    frozen_over: int = 5       # equal values in a row beyond which all but the first are false


def spikes_in_block(track, frame, x, y, p: SpikeParams) -> tuple[np.ndarray, np.ndarray]:
    """(leaps, out of range) of usable readings in track order."""
    n = len(frame)
    out = (np.abs(x) > p.half_length + p.margin) | (np.abs(y) > p.half_width + p.margin)
    leap = np.zeros(n, dtype=bool)
    if not n:
        return leap, out
    t = frame / 25.0
    counts = np.bincount(track)
    starts = np.cumsum(counts) - counts
    cx = np.clip(x, -2 * p.half_length, 2 * p.half_length)
    cy = np.clip(y, -2 * p.half_width, 2 * p.half_width)
    scatter = scatter_by_track(track, t, cx, cy)
    index = profile_windows(starts, counts, p.width)
    candidate = np.zeros(n, dtype=bool)
    if len(index):
        matrix = np.concatenate([detrend(cx[index], t[index]), detrend(cy[index], t[index])])
        _, sparse, _ = robust_pca(matrix, p.rank)
        hit = (sparse[: len(index)] != 0) | (sparse[len(index):] != 0)
        candidate[index[hit]] = True
    candidate &= ~out
    good = ~candidate & ~out
    test = partial(off_course, track=track, t=t, x=cx, y=cy, scatter=scatter, floor=p.floor, sigmas=p.sigmas, push=p.push, pace=p.pace, reach=p.reach)
    # A short track has no profile: its longest course is good, each reading is tested without itself.
    short = (counts[track] < p.width) & ~out
    on, most = longest_course(track, t, cx, cy, np.maximum(p.floor, p.sigmas * scatter), short, pace=p.pace)
    good &= ~short | on
    candidate |= short & most & ~on
    first = test(short & most & on, good)
    candidate[first], good[first] = True, False
    leap[test(candidate, good)] = True
    return leap, out


def value_runs(owner: np.ndarray, place: np.ndarray, value: np.ndarray, block: int, part: int, over: int):
    """Frozen places inside the block, and the border pieces of each owner's value runs.

    Inside pieces are whole, so they are decided here; the first and last piece of an owner
    may go on in another block and are returned as (owner, part, block, nth, value, places).
    """
    n = len(value)
    if not n:
        return [], []
    new = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], n)
    whose = owner[head]
    first = np.append(True, whose[1:] != whose[:-1])
    last = np.append(first[1:], True)
    inside = [(int(whose[k]), place[head[k] + 1:tail[k]]) for k in np.flatnonzero(~first & ~last & (tail - head > over))]
    border = [(int(whose[k]), part, block, int(not first[k]), float(value[head[k]]), place[head[k]:tail[k]])
              for k in np.flatnonzero(first | last)]
    return inside, border


def _marks(match_id, ids: np.ndarray, block: int, found: dict[str, list], border: list) -> pa.Table:
    rows = [(int(ids[o]), _PART[kind], block, 0, None, places) for kind, each in found.items() for o, places in each if len(places)]
    rows += [(int(ids[o]), *rest) for o, *rest in border]
    columns = list(zip(*rows)) if rows else [[]] * 6
    table = pa.Table.from_arrays([pa.array([*c], type=f.type) for c, f in zip(columns, _MARKS)], schema=_MARKS)
    return table.add_column(0, pa.field("match_id", pa.string()), pa.array([match_id] * len(rows), type=pa.string()))


def _by_owner(owner: np.ndarray, place: np.ndarray, flag: np.ndarray) -> list:
    own, where = owner[flag], place[flag]
    if not len(own):
        return []
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return [(int(own[a]), where[a:b]) for a, b in zip(head, np.append(head[1:], len(own)))]


def _resolve(marks: DataFrame, over: int) -> DataFrame:
    """Marks to (match_id, id, place, reason); border pieces are joined into whole runs.

    The window groups hold only border pieces (two per owner, block and column); flagged
    places stay in groups of their own block, so no group gathers an owner's readings.
    """
    group = [F.col("match_id"), F.col("id"), F.col("part"), F.when(F.col("part") < 0, F.col("block"))]
    order = Window.partitionBy(*group).orderBy("block", "nth")
    before = F.lag("value").over(order)
    runs = marks.withColumn("_new", F.when(F.col("value") == before, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    whole = Window.partitionBy(*group, "_run")
    total = F.sum(F.size("places")).over(whole)
    nth = F.row_number().over(whole.orderBy("block", "nth"))
    runs = runs.select("match_id", "id", "part", "places", total.alias("_total"), nth.alias("_nth"))
    places = (F.when(F.col("part") < 0, F.col("places"))
              .when((F.col("_total") > over) & (F.col("_nth") == 1), F.slice("places", 2, F.size("places")))
              .when(F.col("_total") > over, F.col("places")))
    reason = F.when(F.col("part") == _PART[LEAP], LEAP).when(F.col("part") == _PART[RANGE], RANGE).otherwise(FROZEN)
    return runs.select("match_id", "id", F.explode(places).alias("place"), reason.alias("reason"))


def position_spikes(frames: DataFrame, params: SpikeParams = SpikeParams(), span: int = SPAN, halo: int = HALO) -> DataFrame:
    """``match_id, id, frame, reason``: false positions of tracks in recording lines.

    A reading may have several reasons, each in a row of its own.
    """

    def block(key: tuple, lines: pa.Table) -> pa.Table:
        match_id, number = key[0].as_py(), int(key[1].as_py())
        r = usable(block_readings(lines))
        leap, out = spikes_in_block(r.track, r.frame, r.x, r.y, params)
        core = (r.frame >= number * span) & (r.frame < (number + 1) * span)
        found = {LEAP: _by_owner(r.track, r.frame, leap & core), RANGE: _by_owner(r.track, r.frame, out & core), FROZEN: []}
        border: list = []
        for part, value in enumerate((r.x, r.y)):
            inside, edge = value_runs(r.track[core], r.frame[core], value[core], number, part, params.frozen_over)
            found[FROZEN] += inside
            border += edge
        return _marks(match_id, r.ids, number, found, border)

    marks = line_blocks(frames, span, halo).groupBy("match_id", "block").applyInArrow(block, _MARKS_DDL)
    return _resolve(marks, params.frozen_over).withColumnRenamed("place", "frame")


@dataclass(frozen=True)
class SummaryParams:
    """Thresholds of the summary test."""

    top: float = 12.5            # no one runs faster, m/s
    sigmas: float = 4.0          # robust standard deviations of the logarithm within the source
    least_sigma: float = 0.08    # spread of the logarithm that is always granted
    share: float = 0.25          # distance may differ so much from seconds x average speed
    real_m: float = 1.0          # a distance above this needs a top speed above zero
    frozen_over: int = 5
    ids_per_block: int = 4096


def _log(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(v > 0, np.log(np.where(v > 0, v, 1.0)), np.nan)


def summary_spikes_in_block(seconds, distance, average, top, centre: np.ndarray, spread: np.ndarray, p: SummaryParams) -> tuple[np.ndarray, np.ndarray]:
    """(false top speeds, false distances) among summaries of one source.

    ``centre`` and ``spread`` (median absolute deviation) are those of the whole source, of the
    logarithms of top speed, pace and average speed; NaN where the source has none.
    """
    pace = np.where(seconds > 0, distance / np.where(seconds > 0, seconds, 1.0), np.nan)
    z = (np.stack([_log(top), _log(pace), _log(average)], axis=1) - centre) / np.maximum(MAD_TO_SIGMA * spread, p.least_sigma)
    _, sparse, _ = robust_pca(np.nan_to_num(np.clip(z, -50, 50)), rank=1, cut=2.0)
    with np.errstate(invalid="ignore"):
        known = np.isfinite(top)
        impossible = known & ((top < 0) | (top > p.top) | ((top == 0) & (distance > p.real_m)))
        fast = impossible | (known & (sparse[:, 0] != 0) & (z[:, 0] > p.sigmas))
        expected = seconds * average
        told = np.isfinite(distance) & np.isfinite(expected)
        off = told & (np.abs(distance - expected) > p.share * expected + 0.0006 * seconds + 0.05)
        alone = np.isfinite(distance) & ~np.isfinite(expected) & (sparse[:, 1] != 0) & (np.abs(z[:, 1]) > p.sigmas)
        far = (np.isfinite(distance) & ((distance < 0) | (pace > p.top))) | off | alone
    return fast, far


def summary_spikes(analytics: DataFrame, params: SummaryParams = SummaryParams()) -> DataFrame:
    """``field, match_id, id, reason``: false ``max_speed_ms`` and ``distance_m`` of summaries.

    Deliveries of a row that differ only in ``computed_at`` count once; should a row have
    several versions, the one computed last holds.  Order within a source is ``id``.
    """
    names = ["seconds", "distance_m", "avg_speed_ms", "max_speed_ms"]
    logs = ["_top", "_pace", "_average"]
    rows = (analytics.where(F.col("match_id").isNotNull() & F.col("id").isNotNull())
            .groupBy("match_id", "id").agg(F.max_by(F.struct(*[F.col(n).cast("double").alias(n) for n in names]), F.struct("computed_at", *names)).alias("s"))
            .select("match_id", "id", F.floor(F.col("id") / params.ids_per_block).alias("block"), "s.*"))
    # Centre and spread are those of the match (a row each, so broadcast: a match may hold most rows);
    # pieces, equal by hash, only bound the task.
    pace = F.when(F.col("seconds") > 0, F.col("distance_m") / F.col("seconds"))
    log = lambda c: F.when((c > 0) & (c < float("inf")), F.ln(c))
    half = lambda c: F.percentile_approx(c, 0.5, 10_000)
    told = rows.withColumns(dict(zip(logs, (log(F.col("max_speed_ms")), log(pace), log(F.col("avg_speed_ms"))))))
    centres = told.groupBy("match_id").agg(F.count("*").alias("_n"), *[half(c).alias(f"{c}_at") for c in logs])
    placed = told.join(F.broadcast(centres), "match_id")
    spreads = placed.groupBy("match_id").agg(*[half(F.abs(F.col(c) - F.col(f"{c}_at"))).alias(f"{c}_by") for c in logs])
    pieces = placed.join(F.broadcast(spreads), "match_id").withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / params.ids_per_block)))

    def judge(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        ids = part["id"].to_numpy()
        values = (np.asarray(part[n].to_pandas(), dtype=np.float64) for n in names)
        centre, spread = (np.array([np.nan if (v := part[c + end][0].as_py()) is None else v for c in logs]) for end in ("_at", "_by"))
        flags = summary_spikes_in_block(*values, centre, spread, params)
        return pa.concat_tables([_marks(key[0].as_py(), np.array([column]), int(key[1].as_py()), {RANGE: [(0, ids[flag])]}, []) for column, flag in enumerate(flags)])

    def block(key: tuple, part: pa.Table) -> pa.Table:
        match_id, number = key[0].as_py(), int(key[1].as_py())
        part = part.sort_by("id")
        ids = part["id"].to_numpy()
        whole = np.zeros(len(ids), dtype=np.int64)
        tables = []
        for column, name in enumerate(("max_speed_ms", "distance_m")):
            value = np.asarray(part[name].to_pandas(), dtype=np.float64)
            finite = np.isfinite(value)
            inside, edge = value_runs(whole[finite], ids[finite], value[finite], number, column, params.frozen_over)
            tables.append(_marks(match_id, np.array([column]), number, {FROZEN: inside}, edge))
        return pa.concat_tables(tables)

    kept = ["match_id", "piece", "id", *names, *[f"{c}{end}" for c in logs for end in ("_at", "_by")]]
    marks = (rows.select("match_id", "block", "id", "max_speed_ms", "distance_m").groupBy("match_id", "block").applyInArrow(block, _MARKS_DDL)
             .unionByName(pieces.select(*kept).groupBy("match_id", "piece").applyInArrow(judge, _MARKS_DDL)))
    field = F.when(F.col("id") == 0, "analytics.max_speed_ms").otherwise("analytics.distance_m")
    return _resolve(marks, params.frozen_over).select(field.alias("field"), "match_id", F.col("place").alias("id"), "reason")


def implausible_values(frames: DataFrame, analytics: DataFrame, position: SpikeParams = SpikeParams(), summary: SummaryParams = SummaryParams()) -> DataFrame:
    """``field, match_id, id, frame, reason`` over recording lines and summaries (frame -1)."""
    a = position_spikes(frames, position).select(F.lit("frames.xy").alias("field"), "match_id", "id", "frame", "reason")
    b = summary_spikes(analytics, summary).select("field", "match_id", "id", F.lit(-1).cast("bigint").alias("frame"), "reason")
    return a.unionByName(b)

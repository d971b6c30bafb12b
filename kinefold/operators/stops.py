"""Stops and trips from position pings (problem 4).

Spatio-temporal density clustering per track: a ping is a core of a stop when enough of the
pings near it in time are also near it in space; runs of cores are clusters, clusters of at
least ``least_stop_s`` become stops, the ordered noise between them becomes trips.

A track may be long, so blocks of time are worked on apart with ten seconds of context on
either side (more than the shortest stop and as much as the longest silence that ends
nothing), and pieces that touch a block's border are joined afterwards.

Defined results: empty tables give no rows; a track with a single ping gives none (nothing
lasts); repeated lines count once; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinefold.operators.blocks import FPS, HALO, SPAN, block_readings, line_blocks, usable
from kinefold.operators.robust_pca import scatter_by_track
from kinefold.operators.spikes import SpikeParams, spikes_in_block


@dataclass(frozen=True)
class StopParams:
    """Distances in metres, times in seconds."""

    eps: float = 0.9            # neighbourhood in space: at least this ...
    eps_sigmas: float = 4.0     # ... or so many scatters
    tau: float = 3.0            # neighbourhood in time, either side
    density: float = 0.85       # share of the pings near in time, on the better side, that must be near in space
    spot: float = 1.5           # clusters about one spot are one
    least_cluster: float = 0.8  # shorter runs of cores are noise
    bridge: float = 2.0         # noise shorter than this between them is scatter
    least_stop: float = 8.0
    least_trip: float = 4.0
    silence: float = 10.0
    frozen_over: int = 5


def frozen(track: np.ndarray, x: np.ndarray, y: np.ndarray, over: int) -> np.ndarray:
    """All but the first of more than ``over`` readings in a row with an unchanged coordinate."""
    flag = np.zeros(len(track), dtype=bool)
    for v in (x, y):
        new = np.append(True, (track[1:] != track[:-1]) | (v[1:] != v[:-1])) if len(v) else flag
        size = np.bincount(np.cumsum(new) - 1) if len(v) else np.zeros(0, dtype=int)
        flag |= (size[np.cumsum(new) - 1] > over) & ~new if len(v) else flag
    return flag


def core_pings(session: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, eps: np.ndarray, tau: float, density: float) -> np.ndarray:
    """ST-DBSCAN's core test: at least ``density`` of the pings within ``tau`` lie within ``eps``.

    Sides count apart and the denser one decides, so the first and last ping of a stop are cores.
    """
    n = len(t)
    near, there = np.zeros((2, n)), np.zeros((2, n))
    for k in range(1, n):
        pair = (session[k:] == session[:-k]) & (t[k:] - t[:-k] <= tau)
        if not pair.any():
            break
        a = np.flatnonzero(pair)
        b = a + k
        close = np.hypot(x[b] - x[a], y[b] - y[a]) <= np.minimum(eps[a], eps[b])
        there[1, a] += 1
        there[0, b] += 1
        near[1, a] += close
        near[0, b] += close
    share = (near + 1) / (there + 1)
    return (share >= density).any(axis=0) & (there.sum(axis=0) > 0)


def _arrival(t, x, y, outside: np.ndarray, inside_t: float, cx: float, cy: float) -> float:
    """Moment at which the course through the nearest pings outside reaches the spot.

    ``outside`` holds indices ordered from the nearest to the stop outwards.
    """
    if not len(outside):
        return inside_t
    o = outside[0]
    d = np.hypot(x[o] - cx, y[o] - cy)
    speed = 0.0
    if len(outside) > 1:
        p = outside[min(2, len(outside) - 1)]
        span = abs(t[o] - t[p])
        if span > 0:
            speed = (np.hypot(x[p] - cx, y[p] - cy) - d) / span
    if speed <= 0.2:
        return 0.5 * (t[o] + inside_t)
    moment = t[o] + np.sign(inside_t - t[o]) * d / speed
    low, high = min(t[o], inside_t), max(t[o], inside_t)
    reach = 1.0
    return float(np.clip(moment, low - (0 if t[o] < inside_t else reach), high + (reach if t[o] < inside_t else 0)))


def stops_in_session(t, x, y, core, sigma: float, begin: float, end: float, p: StopParams) -> list[tuple[float, float]]:
    """Stop intervals of one session (no silence inside) from its plausible pings."""
    where = np.flatnonzero(core)
    if not len(where):
        return []
    eps = max(p.eps, p.eps_sigmas * sigma)
    gap = (np.diff(where) != 1) | (np.hypot(np.diff(x[where]), np.diff(y[where])) > eps * 1.5)
    heads, tails = where[np.append(True, gap)], where[np.append(gap, True)]
    lasting = t[tails] - t[heads] >= p.least_cluster
    sx, sy = np.append(0.0, np.cumsum(x)), np.append(0.0, np.cumsum(y))
    merged: list[list] = []
    for a, b in zip(heads[lasting].tolist(), tails[lasting].tolist()):
        if merged:
            i, j = merged[-1]
            apart = np.hypot((sx[b + 1] - sx[a]) / (b + 1 - a) - (sx[j + 1] - sx[i]) / (j + 1 - i), (sy[b + 1] - sy[a]) / (b + 1 - a) - (sy[j + 1] - sy[i]) / (j + 1 - i))
            if apart <= p.spot * 0.6 + sigma and t[a] - t[j] <= (p.silence if a == j + 1 else p.bridge):
                merged[-1][1] = b
                continue
        merged.append([a, b])
    near = max(0.9, 3.2 * sigma)
    found = []
    n = len(t)
    for a, b in merged:
        if t[b] - t[a] < 0.5 * p.least_stop:
            continue
        mid = slice(a + (b - a) // 4, b - (b - a) // 4 + 1)
        cx, cy = np.median(x[mid]), np.median(y[mid])
        d = np.hypot(x - cx, y - cy)
        ok = d <= near
        lo, hi = max(0, a - 60), min(n, b + 61)
        inner = np.flatnonzero(ok[lo:hi]) + lo
        inner = inner[(inner >= a - 60) & (inner <= b + 60)]
        if not len(inner):
            continue
        # grow from the middle while at most two pings in a row are off the spot
        gaps = np.flatnonzero(np.diff(inner) > 3)
        centre = np.searchsorted(inner, (a + b) // 2)
        left = gaps[gaps < centre]
        right = gaps[gaps >= centre]
        i, j = inner[left[-1] + 1 if len(left) else 0], inner[right[0] if len(right) else len(inner) - 1]
        start = begin if i == 0 else max(begin, _arrival(t, x, y, np.arange(i - 1, max(-1, i - 4), -1), t[i], cx, cy))
        stop = end if j == n - 1 else min(end, _arrival(t, x, y, np.arange(j + 1, min(n, j + 4)), t[j], cx, cy))
        if stop - start >= p.least_stop:
            if found and start < found[-1][1]:
                start = found[-1][1]
                if stop - start < p.least_stop:
                    continue
            found.append((start, stop))
    return found


_PIECES = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("block", pa.int64()), ("start_frame", pa.float64()), ("end_frame", pa.float64()),
                     ("open", pa.bool_()), ("pings", pa.int64()), ("distance", pa.float64()), ("sx", pa.float64()), ("sy", pa.float64())])
_PIECES_DDL = ("match_id string, id bigint, kind string, block bigint, start_frame double, end_frame double, open boolean, pings bigint, "
               "distance double, sx double, sy double")


def pieces_in_block(ids, track, frame, x, y, lower: float, upper: float, number: int, p: StopParams, spikes: SpikeParams) -> list[tuple]:
    """Stop and trip pieces of the block [lower, upper), from its usable pings and those of the halo."""
    if not len(frame):
        return []
    t = frame / FPS
    leap, out = spikes_in_block(track, frame, x, y, spikes)
    sound = ~(leap | out | frozen(track, x, y, p.frozen_over))
    new = np.append(True, (track[1:] != track[:-1]) | (np.diff(frame) > p.silence * FPS))
    session = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(frame))
    scatter = scatter_by_track(track[sound], t[sound], x[sound], y[sound])
    s_of, t_s, x_s, y_s = session[sound], t[sound], x[sound], y[sound]
    core = core_pings(s_of, t_s, x_s, y_s, np.maximum(p.eps, p.eps_sigmas * scatter), p.tau, p.density)
    cuts = np.searchsorted(s_of, np.arange(len(heads) + 1))
    rows = []
    for k, (a, b) in enumerate(zip(heads, tails)):
        first, last = float(frame[a]), float(frame[b - 1])
        if last < lower or first >= upper or last <= first:
            continue
        u, v = cuts[k], cuts[k + 1]
        sigma = float(scatter[u]) if v > u else 0.1
        stops = stops_in_session(t_s[u:v], x_s[u:v], y_s[u:v], core[u:v], sigma, first / FPS, last / FPS, p)
        edges, kinds = [first], []
        for i, j in stops:
            i, j = round(i * FPS, 6), round(j * FPS, 6)
            if i > edges[-1]:
                edges.append(i)
                kinds.append("trip")
            edges.append(j)
            kinds.append("stop")
        if edges[-1] < last:
            edges.append(last)
            kinds.append("trip")
        f_s = t_s[u:v] * FPS
        step = np.append(0.0, np.hypot(np.diff(x_s[u:v]), np.diff(y_s[u:v]))) if v > u else np.zeros(0)
        for kind, i, j in zip(kinds, edges[:-1], edges[1:]):
            lo, hi = max(i, lower), min(j, upper)
            if hi < lo or (hi == lo and i != j):
                continue
            mine = (f_s > lo) & (f_s <= hi) if i < lo or i > first else (f_s >= lo) & (f_s <= hi)
            rows.append((int(ids[track[a]]), kind, number, lo, hi, bool(i < lower or j > upper or (j == upper) or (i == lower)), int(mine.sum()),
                         float(step[mine].sum()), float(x_s[u:v][mine].sum()), float(y_s[u:v][mine].sum())))
    return rows


def stops_and_trips(frames: DataFrame, params: StopParams = StopParams(), spikes: SpikeParams = SpikeParams(), span: int = SPAN, halo: int = HALO) -> DataFrame:
    """``match_id, id, kind, start_frame, end_frame, duration_s, distance_m, pings, x, y``.

    ``x, y`` is the mean position (of a stop: its spot); distance is the length of the course
    through the plausible pings.  Frames are moments, so they may lie between two pings.
    """
    if halo < params.silence * FPS or halo < params.least_stop * FPS:
        raise ValueError("the halo must cover the longest silence and the shortest stop")

    def block(key: tuple, lines: pa.Table) -> pa.Table:
        match_id, number = key[0].as_py(), int(key[1].as_py())
        r = usable(block_readings(lines))
        rows = pieces_in_block(r.ids, r.track, r.frame, r.x, r.y, number * span, (number + 1) * span, number, params, spikes)
        columns = list(zip(*rows)) if rows else [[]] * len(_PIECES)
        table = pa.Table.from_arrays([pa.array([*c], type=f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)
        return table.add_column(0, pa.field("match_id", pa.string()), pa.array([match_id] * len(rows), type=pa.string()))

    pieces = line_blocks(frames, span, halo).groupBy("match_id", "block").applyInArrow(block, _PIECES_DDL)
    # Only pieces at a border meet per track; the others stay in groups of their block.
    group = [F.col("match_id"), F.col("id"), F.when(F.col("open"), -1).otherwise(F.col("block"))]
    order = Window.partitionBy(*group).orderBy("start_frame", "end_frame")
    goes_on = F.col("open") & (F.lag("kind").over(order) == F.col("kind")) & (F.lag("end_frame").over(order) == F.col("start_frame"))
    joined = pieces.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    least = F.when(F.col("kind") == "stop", params.least_stop).otherwise(params.least_trip)
    total = (joined.groupBy(*group[:2], group[2].alias("_group"), "_run", "kind")
             .agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("pings").alias("pings"),
                  F.sum("distance").alias("distance_m"), F.sum("sx").alias("_sx"), F.sum("sy").alias("_sy"))
             .withColumn("duration_s", (F.col("end_frame") - F.col("start_frame")) / FPS).where(F.col("duration_s") >= least))
    return total.select("match_id", "id", "kind", "start_frame", "end_frame", "duration_s", "distance_m", "pings",
                        F.try_divide("_sx", "pings").alias("x"), F.try_divide("_sy", "pings").alias("y"))

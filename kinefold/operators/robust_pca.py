"""Robust principal components on profile matrices, and the course test for single readings.

Pure NumPy kernels: they see one bounded block (one source, one stretch of time) and
are called from grouped Arrow functions, so nothing here knows about Spark.
"""

from __future__ import annotations

import numpy as np

#: Scale from a median absolute deviation to a standard deviation of a normal law.
MAD_TO_SIGMA = 1.4826


def robust_pca(m: np.ndarray, rank: int = 3, iterations: int = 8, cut: float = 4.0):
    """Split ``m`` (profiles x positions) into low rank + sparse + small noise.

    Alternating projections: the low-rank part is the projection on the leading
    eigenvectors of the Gram matrix of (m - sparse), the sparse part keeps the
    entries whose residual passes ``cut`` robust standard deviations of their row
    or of the whole matrix, whichever is larger.  The Gram matrix is only
    positions x positions, so a step costs one thin product.

    Returns ``(low_rank, sparse, sigma)``.
    """
    if m.size == 0:
        return m.copy(), np.zeros_like(m), 0.0
    rank = min(rank, m.shape[1])
    # A gross entry must not steer the first projection: start from clipped data.
    spread = MAD_TO_SIGMA * np.median(np.abs(m)) + 1e-9
    sparse = m - np.clip(m, -6 * spread, 6 * spread)
    low = np.zeros_like(m)
    sigma = spread
    for step in range(iterations):
        clean = m - sparse
        _, vectors = np.linalg.eigh(clean.T @ clean)
        basis = vectors[:, -min(rank, 1 + step):]
        low = (clean @ basis) @ basis.T
        residual = m - low
        size = np.abs(residual)
        sigma = MAD_TO_SIGMA * np.median(size) + 1e-9
        row = MAD_TO_SIGMA * np.median(size, axis=1, keepdims=True)
        sparse = np.where(size > cut * np.maximum(row, sigma), residual, 0.0)
    return low, sparse, sigma


def profile_windows(starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Index matrix (profiles x width) that covers every track of at least ``width`` readings.

    Windows follow one another; a track's last window is aligned to its end.
    """
    long = counts >= width
    starts, counts = starts[long], counts[long]
    if not len(starts):
        return np.zeros((0, width), dtype=np.int64)
    full = counts // width
    rest = (counts % width > 0).astype(np.int64)
    total = full + rest
    owner = np.repeat(np.arange(len(starts)), total)
    nth = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    first = np.minimum(nth * width, counts[owner] - width) + starts[owner]
    return first[:, None] + np.arange(width)


def detrend(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Take a resistant line (half medians over true times) from every profile."""
    half = values.shape[1] // 2
    dt = np.median(times[:, half:], axis=1) - np.median(times[:, :half], axis=1)
    slope = (np.median(values[:, half:], axis=1) - np.median(values[:, :half], axis=1)) / np.maximum(dt, 1e-6)
    flat = values - slope[:, None] * (times - times[:, :1])
    return flat - np.median(flat, axis=1, keepdims=True)


def scatter_by_track(track: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per-axis scatter of every reading's track, from errors of interpolation between neighbours.

    Tracks with few readings take the scatter of the block.
    """
    n = len(t)
    out = np.full(n, 0.1)
    if n < 3:
        return out
    inner = track[:-2] == track[2:]
    share = (t[1:-1] - t[:-2]) / np.maximum(t[2:] - t[:-2], 1e-9)
    err = np.hypot(x[1:-1] - x[:-2] - (x[2:] - x[:-2]) * share, y[1:-1] - y[:-2] - (y[2:] - y[:-2]) * share)
    err, owner = err[inner], track[1:-1][inner]
    if not len(err):
        return out
    # One leap spoils up to three errors: among very few they would be the median.
    calm = err if len(err) >= 20 else np.sort(err)[:-3]
    block = np.median(calm) / 1.44 if len(calm) else 0.1
    order = np.lexsort((err, owner))
    err, owner = err[order], owner[order]
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    sizes = np.diff(np.append(heads, len(owner)))
    middle = err[heads + (sizes - 1) // 2] / 1.44
    per = np.full(int(track.max()) + 1, block)
    enough = sizes >= 20
    per[owner[heads[enough]]] = middle[enough]
    return np.maximum(per[track], 0.02)


def _side(good: np.ndarray, place: np.ndarray, step: int, track, t, x, y, at: np.ndarray, reach: float, most: int = 3):
    """Nearest good readings on one side of the readings ``at``: a local line, and the nearest one.

    Returns predicted x, y, nearest x, y, time to the nearest; NaN where there is none in reach.
    """
    n = len(good)
    sums = [np.zeros(len(at)) for _ in range(6)]
    near = [np.full(len(at), np.nan) for _ in range(3)]
    alive = np.ones(len(at), dtype=bool)
    for k in range(most):
        j = place + step * k if step > 0 else place - 1 - k
        ok = alive & (j >= 0) & (j < n)
        g = good[np.clip(j, 0, max(n - 1, 0))] if n else np.zeros(len(at), dtype=np.int64)
        dt = t[g] - t[at]
        ok &= (track[g] == track[at]) & (np.abs(dt) <= reach)
        alive = ok
        w = ok.astype(float)
        for s, v in zip(sums, (w, w * dt, w * dt * dt, w * x[g], w * y[g], None)):
            if v is not None:
                s += v
        sums[5] += w * dt * x[g]
        if k == 0:
            near = [np.where(ok, x[g], np.nan), np.where(ok, y[g], np.nan), np.where(ok, np.abs(dt), np.nan)]
            sdy = w * dt * y[g]
        else:
            sdy = sdy + w * dt * y[g]
    c, st, stt, sx, sy, sxt = sums
    det = c * stt - st * st
    line = (c >= 2) & (det > 1e-9)
    safe = np.where(line, det, 1.0)
    px = np.where(line, (stt * sx - st * sxt) / safe, near[0])
    py = np.where(line, (stt * sy - st * sdy) / safe, near[1])
    return px, py, near[0], near[1], near[2]


def off_course(candidate: np.ndarray, good: np.ndarray, track, t, x, y, scatter, *, floor: float, sigmas: float,
               push: float, pace: float, reach: float) -> np.ndarray:
    """Exact test: which candidates lie off the course before, after and between their good neighbours.

    A reading is off when no prediction (line before, line after, interpolation, either
    neighbour itself) comes nearer than ``max(floor, sigmas * scatter)`` plus what a push of
    ``push`` m/s2 explains over the time to the nearer neighbour.  Where only one side is
    within ``reach`` seconds, the reading must also be out of running distance at ``pace``.
    A candidate that is itself good is no neighbour of its own.
    """
    at = np.flatnonzero(candidate)
    if not len(at):
        return at
    keep = np.flatnonzero(good)
    place = np.searchsorted(keep, at)
    with np.errstate(invalid="ignore", over="ignore"):
        ax, ay, pax, pay, da = _side(keep, place, -1, track, t, x, y, at, reach)
        bx, by, pbx, pby, db = _side(keep, place + good[at], 1, track, t, x, y, at, reach)
        share = da / np.maximum(da + db, 1e-9)
        ix, iy = pax + (pbx - pax) * share, pay + (pby - pay) * share
        each = [np.hypot(x[at] - u, y[at] - v) for u, v in ((ax, ay), (bx, by), (ix, iy), (pax, pay), (pbx, pby))]
        far = np.fmin.reduce(each)
        wait = np.fmin(da, db)
        allowed = np.maximum(floor, sigmas * scatter[at]) + 0.5 * push * np.minimum(wait, 2.0) ** 2
        one = np.isnan(da) | np.isnan(db)
        run = np.fmin(each[3], each[4]) > pace * wait + np.maximum(floor, sigmas * scatter[at])
        off = np.where(one, run & (wait <= 2.0), True) & (far > allowed)
    return at[off & ~np.isnan(far)]


def longest_course(track, t, x, y, slack, short: np.ndarray, *, pace: float) -> tuple[np.ndarray, np.ndarray]:
    """For the few readings of every ``short`` track: (on its longest course, the course holds most of them).

    A course is a chain of readings, each within running distance (and ``slack``) of the next.
    """
    on, most = np.zeros(len(t), dtype=bool), np.zeros(len(t), dtype=bool)
    where = np.flatnonzero(short)
    heads = np.flatnonzero(np.append(True, track[where][1:] != track[where][:-1])) if len(where) else where
    for a, b in zip(heads, np.append(heads[1:], len(where))):
        k = where[a:b]
        far = np.hypot(x[k][:, None] - x[k], y[k][:, None] - y[k])
        near = far <= pace * np.abs(t[k][:, None] - t[k]) + slack[k]
        length, before = np.ones(len(k), dtype=int), np.full(len(k), -1)
        for j in range(1, len(k)):
            best = np.where(near[:j, j], length[:j], 0)
            i = int(j - 1 - np.argmax(best[::-1]))
            if best[i]:
                length[j], before[j] = best[i] + 1, i
        j = int(np.argmax(length))
        most[k] = 2 * length[j] > len(k)
        while j >= 0:
            on[k[j]] = True
            j = before[j]
    return on, most

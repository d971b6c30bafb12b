"""Acceptance of camera homographies over time: plausibility, jumps, confirmation.

What a homography shows is a matter of one keyframe (``views``: arithmetic over a whole Arrow
batch of matrices, no order); only the short fold over its numbers (``Guard``) runs in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# Places in the image (shares of width and height) that stand for what a view shows.
GRID_ACROSS, GRID_DOWN, CENTRE = (0.1, 0.5, 0.9), (0.4, 0.7, 0.95), (0.5, 0.7)
CORNERS = ((0.0, 1.0), (1.0, 1.0), (1.0, 0.4), (0.0, 0.4))
# Limits of a valid and of a plausible view, in metres and square metres.
LEAST_DETERMINANT, MOST_CONDITION = 1e-12, 1e9
CENTRE_ACROSS, CENTRE_ALONG, FARTHEST, LEAST_AREA, MOST_AREA, FIRST_RADIUS = 70.0, 45.0, 250.0, 100.0, 20_000.0, 120.0
# Rules of the fold.
JUMP, WARP_SHARE, CONFIRM, AGREE, AGREE_LOOSE, LOOSE_AFTER = 8.0, 0.25, 2, 2.0, 4.0, 3


def area(q: np.ndarray) -> np.ndarray:
    """Shoelace areas of polygons (..., corners, 2)."""
    x, y = q[..., 0], q[..., 1]
    return np.abs((x * np.roll(y, -1, axis=-1) - y * np.roll(x, -1, axis=-1)).sum(axis=-1)) / 2


def crossing(q: np.ndarray) -> np.ndarray:
    """Do quadrilaterals (..., 4, 2) cross themselves?"""
    a, b, c, d = (q[..., k, :] for k in range(4))

    def turn(p, r, s):
        return np.sign((r[..., 0] - p[..., 0]) * (s[..., 1] - p[..., 1]) - (r[..., 1] - p[..., 1]) * (s[..., 0] - p[..., 0]))

    def meet(p, r, s, t):
        return (turn(p, r, s) * turn(p, r, t) < 0) & (turn(s, t, p) * turn(s, t, r) < 0)
    return meet(a, b, c, d) | meet(b, c, d, a)


def views(h: np.ndarray, width: float = 1920.0, height: float = 1080.0) -> dict[str, np.ndarray]:
    """``valid, plausible, centre, grid`` of matrices (n, 3, 3); multiplying a matrix changes nothing.

    A view is valid if its matrix is finite, regular and well conditioned, the image centre is
    not at the horizon, and the grid over the lower part of the image lies on one side of it.
    """
    with np.errstate(all="ignore"):
        finite = np.isfinite(h).all(axis=(1, 2))
        safe = np.where(finite[:, None, None], h, np.eye(3))
        regular = finite & (np.abs(np.linalg.det(safe)) > LEAST_DETERMINANT) & (np.linalg.cond(safe) < MOST_CONDITION) & (safe[:, 2, 2] != 0)
        unit = safe / np.where(safe[:, 2, 2] != 0, safe[:, 2, 2], 1.0)[:, None, None]

        def project(shares):
            at = np.array([[u * width, v * height, 1.0] for u, v in shares])
            p = at @ unit.transpose(0, 2, 1)
            return p[..., :2] / p[..., 2:], p[..., 2]
        grid, depth = project([(u, v) for v in GRID_DOWN for u in GRID_ACROSS])
        centre, _ = project([CENTRE])
        corners, corner_depth = project(CORNERS)
        _, middle = project([(0.5, 0.5)])
        one_side = ((depth > 0).all(axis=1) | (depth < 0).all(axis=1)) & np.isfinite(grid).all(axis=(1, 2))
        valid = regular & one_side & (np.abs(middle[:, 0]) > 1e-9)
        size = area(corners)
        plausible = (valid & (np.abs(centre[:, 0, 0]) <= CENTRE_ACROSS) & (np.abs(centre[:, 0, 1]) <= CENTRE_ALONG) & (np.hypot(grid[..., 0], grid[..., 1]) <= FARTHEST).all(axis=1)
                     & np.isfinite(corners).all(axis=(1, 2)) & (corner_depth != 0).all(axis=1) & ~crossing(corners) & (size >= LEAST_AREA) & (size <= MOST_AREA))
    return {"valid": valid, "plausible": plausible, "centre": centre[:, 0], "grid": grid}


@dataclass
class Guard:
    """Ordered fold over views: which one replaces the one in use.

    Near the one in use: accepted.  A view whose centre hardly moves while its grid does is a
    warp, and counts like a jump: refused, unless so many refused views in a row agree.  What
    is implausible is never in use, but for the first valid view that looks near the pitch.
    """

    held: tuple[np.ndarray, np.ndarray] | None = None  # centre and grid in use
    refused: deque[np.ndarray] = field(default_factory=lambda: deque(maxlen=CONFIRM))
    streak: int = 0

    def step(self, valid: bool, plausible: bool, centre: np.ndarray, grid: np.ndarray) -> str:
        """One of accepted_first, accepted, accepted_confirmed, rejected_invalid, rejected_jump."""
        said = self._judge(valid, plausible, centre, grid)
        if said.startswith("accepted"):
            self.held, self.streak = (centre, grid), 0
            self.refused.clear()
        else:
            self.streak += 1
        return said

    def _judge(self, valid, plausible, centre, grid) -> str:
        if self.held is None:
            return "accepted_first" if valid and np.hypot(*centre) <= FIRST_RADIUS else "rejected_invalid"
        if not plausible:
            return "rejected_invalid"
        moved = np.hypot(*(centre - self.held[0]))
        if moved <= JUMP and (moved > WARP_SHARE * JUMP or np.hypot(*(grid - self.held[1]).T).max() <= JUMP):
            return "accepted"
        self.refused.append(centre)
        spread = max(np.hypot(*(a - b)) for a in self.refused for b in self.refused)
        agree = AGREE_LOOSE if self.streak >= LOOSE_AFTER else AGREE
        return "accepted_confirmed" if len(self.refused) == CONFIRM and spread <= agree else "rejected_jump"


def keyframe_views(keyframes: DataFrame, width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """``seq, frame, valid, plausible, centre, grid`` of keyframes (``seq, frame, h`` of nine numbers), in no order."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [v if v is not None and len(v) == 9 and None not in v else [np.nan] * 9 for v in batch.column(2).to_pylist()]
            v = views(np.array(whole, dtype=float).reshape(-1, 3, 3), width, height)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v["valid"]), pa.array(v["plausible"]), pa.array(v["centre"].tolist(), pa.list_(pa.float64())),
                                              pa.array(v["grid"].reshape(len(whole), -1).tolist(), pa.list_(pa.float64()))], names=["seq", "frame", "valid", "plausible", "centre", "grid"])

    return keyframes.select("seq", "frame", "h").mapInArrow(show, "seq string, frame bigint, valid boolean, plausible boolean, centre array<double>, grid array<double>")


def guarded(keyframes: DataFrame, width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """``seq, frame, decision, held_frame``: the decision on every keyframe, and the keyframe in use after it."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame", kind="stable")
        guard, said, held, now = Guard(), [], [], None
        for frame, valid, plausible, centre, grid in zip(part["frame"], part["valid"], part["plausible"], part["centre"], part["grid"]):
            said.append(guard.step(bool(valid), bool(plausible), np.asarray(centre), np.asarray(grid).reshape(-1, 2)))
            now = frame if said[-1].startswith("accepted") else now
            held.append(now)
        return pd.DataFrame({"seq": part["seq"], "frame": part["frame"], "decision": said, "held_frame": pd.array(held, dtype="Int64")})

    return keyframe_views(keyframes, width, height).groupBy("seq").applyInPandas(fold, "seq string, frame bigint, decision string, held_frame bigint")

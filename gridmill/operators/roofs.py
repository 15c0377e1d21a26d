"""Roof models: planes of each building's points, merged and grown, and what roof they make.

A building's points and footprint meet in one task; buildings spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Planes closer than this angle (degrees) and offset (m) are one; the reach of a neighbour (m);
# a direction is opposite from this gap on; planes face one way up to this gap; an eave faces out up to this gap;
# shares that make a roof flat, a gable, a hip, and that a plane and a direction need to count.
SAME_DEG, SAME_M, REACH_M = 8.0, 0.3, 1.5
OPPOSITE_DEG, FACING_DEG, EAVE_DEG = 145.0, 35.0, 50.0
FLAT_SHARE, GABLE_SHARE, HIP_EAVES, PLANE_SHARE, FACING_SHARE = 0.6, 0.85, 0.75, 0.06, 0.07

PLANES = "building_id long, plane int, slope_deg double, aspect_deg double, inliers long, share double, rmse double"
MODELS = "building_id long, roof string, pitch_deg double, ridge_deg double, planes int, covered double, rmse double, eave_share double"


def _fit(p: np.ndarray) -> np.ndarray:
    """(a, b, c) of the least-squares plane h = a x + b y + c."""
    return np.linalg.lstsq(np.column_stack((p[:, :2], np.ones(len(p)))), p[:, 2], rcond=None)[0]


def _off(planes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distance of every point (row) from every plane (column), at right angles to the plane."""
    return np.abs(p[:, :2] @ planes[:, :2].T + planes[:, 2] - p[:, 2:]) / np.sqrt(1 + (planes[:, :2] ** 2).sum(1))


def _proposals(p: np.ndarray, rng: np.random.Generator, trials: int, spread: float = 3.0) -> np.ndarray:
    """Planes through a random point and two of those near it."""
    centre = rng.integers(len(p), size=trials)
    far = np.hypot(p[centre, None, 0] - p[None, :, 0], p[centre, None, 1] - p[None, :, 1])
    draw = np.where(far <= spread, rng.random(far.shape), 2.0)
    draw[np.arange(trials), centre] = -1  # the point itself comes first
    three = p[np.argpartition(draw, 2, axis=1)[:, :3]]
    n = np.cross(three[:, 1] - three[:, 0], three[:, 2] - three[:, 0])
    good = np.abs(n[:, 2]) > 0.2 * np.linalg.norm(n, axis=1) + 1e-9
    n, at = n[good], three[good, 0]
    slope = -n[:, :2] / n[:, 2:]
    return np.column_stack((slope, at[:, 2] - (slope * at[:, :2]).sum(1)))


def _segments(p: np.ndarray, rng: np.random.Generator, threshold: float, least: int, most: int, trials: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Planes one after the other, each taking the points it explains best; -1 for points without."""
    label = np.full(len(p), -1)
    planes: list[np.ndarray] = []
    while len(planes) < most and (label < 0).sum() >= max(least, 3):
        free = np.flatnonzero(label < 0)
        tried = _proposals(p[free], rng, trials)
        if not len(tried):
            break
        hit = _off(tried, p[free]) <= threshold
        mine = free[hit[:, hit.sum(0).argmax()]]
        for _ in range(2):
            if len(mine) < max(least, 3):
                break
            plane = _fit(p[mine])
            mine = free[_off(plane[None], p[free])[:, 0] <= threshold]
        if len(mine) < max(least, 3):
            break
        label[mine] = len(planes)
        planes.append(_fit(p[mine]))
    return planes, label


def _merged(planes: list[np.ndarray], label: np.ndarray, p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The closest pair of planes becomes one, as long as a pair is close in angle and, where their points meet, in height."""
    while len(planes) > 1:
        normal = np.array([[-a, -b, 1.0] for a, b, _ in planes])
        normal /= np.linalg.norm(normal, axis=1, keepdims=True)
        best = None
        for i in range(len(planes)):
            for j in range(i):
                angle = np.degrees(np.arccos(np.clip(normal[i] @ normal[j], -1, 1)))
                middle = p[(label == i) | (label == j), :2].mean(0)
                gap = abs((planes[i] - planes[j]) @ [*middle, 1.0])
                if angle < SAME_DEG and gap < SAME_M and (best is None or (angle, i, j) < best):
                    best = angle, i, j
        if best is None:
            break
        _, i, j = best
        label = np.where(label == i, j, label)
        label = np.where(label > i, label - 1, label)
        planes = [q for k, q in enumerate(planes) if k != i]
        planes[j] = _fit(p[label == j])
    return planes, label


def _grown(planes: list[np.ndarray], label: np.ndarray, p: np.ndarray, threshold: float) -> np.ndarray:
    """Points left over join a plane of a neighbour that they lie on, outwards from the planes until nothing moves."""
    if not planes:
        return label
    off = _off(np.array(planes), p)
    while True:
        free = np.flatnonzero(label < 0)
        known = np.flatnonzero(label >= 0)
        new = label.copy()
        for lo in range(0, len(free), 512):
            some = free[lo : lo + 512]
            near = np.hypot(p[some, None, 0] - p[None, known, 0], p[some, None, 1] - p[None, known, 1]) <= REACH_M
            offered = np.zeros((len(some), len(planes)), dtype=bool)
            for k in range(len(planes)):
                offered[:, k] = near[:, label[known] == k].any(1)
            d = np.where(offered, off[some], np.inf)
            take = d.min(1) < threshold
            new[some[take]] = d.argmin(1)[take]
        if (new == label).all():
            return label
        label = new


def _planes(frame: pd.DataFrame, threshold: float, least: int, most: int, trials: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points about their middle, planes largest first, each point's plane or -1, and the middle."""
    p = frame[["x", "y", "h"]].to_numpy(dtype=float)
    p = p[np.lexsort(p.T)]
    middle = p[:, :2].mean(0)
    p[:, :2] -= middle
    rng = np.random.default_rng(abs(int(frame["building_id"].iloc[0])))
    planes, label = _merged(*_segments(p, rng, threshold, least, most, trials), p)
    label = _grown(planes, label, p, threshold)
    order = sorted(range(len(planes)), key=lambda k: (-(label == k).sum(), k))
    rank = np.full(len(planes) + 1, -1)
    rank[order] = np.arange(len(planes))
    return p, np.array([planes[k] for k in order]).reshape(len(planes), 3), rank[label], middle


def _slopes(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and facing (down, clockwise from north) of planes, in degrees."""
    return np.degrees(np.arctan(np.hypot(planes[:, 0], planes[:, 1]))), np.degrees(np.arctan2(-planes[:, 0], -planes[:, 1])) % 360


def gap_deg(a, b):
    return np.abs((np.asarray(a) - b + 180) % 360 - 180)


def facings(aspect: np.ndarray, weight: np.ndarray) -> list[tuple[float, float]]:
    """(mean direction, weight) of planes that face about the same way, heaviest first: the circle is cut at gaps over the tolerance."""
    order = np.argsort(aspect)
    a, w = aspect[order], weight[order]
    cut = np.flatnonzero((np.roll(a, -1) - a) % 360 > FACING_DEG) if len(a) > 1 else np.array([0])
    runs = [np.arange(len(a))] if not len(cut) else [np.arange(s + 1, e + 1) % len(a) for s, e in zip(cut, np.append(cut[1:], cut[0] + len(a)))]
    out = []
    for r in runs:
        turn = (w[r] * np.exp(1j * np.radians(a[r]))).sum()
        out.append((float(np.degrees(np.angle(turn)) % 360), float(w[r].sum())))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def eave_share(ring: np.ndarray, p: np.ndarray, label: np.ndarray, slope: np.ndarray, aspect: np.ndarray, flat_deg: float) -> float:
    """Share of the outline beside sloped planes across which the plane falls outwards; NaN where no sloped plane lies beside it."""
    if len(ring) < 4:
        return float("nan")
    step = np.diff(ring, axis=0)
    length = np.hypot(step[:, 0], step[:, 1])
    turn = np.sign((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum())
    eaves = beside = 0.0
    for start, (dx, dy), metres in zip(ring[:-1], step, length):
        if metres < 1e-6:
            continue
        n = max(int(round(metres)), 1)
        at = start + (np.arange(n)[:, None] + 0.5) / n * [dx, dy]
        outward = np.degrees(np.arctan2(turn * dy, -turn * dx)) % 360
        near = np.hypot(at[:, None, 0] - p[None, :, 0], at[:, None, 1] - p[None, :, 1]) <= REACH_M
        votes = np.stack([near[:, label == k].sum(1) for k in range(len(slope))], axis=1)
        top = votes.argmax(1)
        told = (votes.sum(1) >= 2) & (slope[top] >= flat_deg)
        beside += metres / n * told.sum()
        eaves += metres / n * (told & (gap_deg(aspect[top], outward) <= EAVE_DEG)).sum()
    return eaves / beside if beside else float("nan")


def kind(slope: np.ndarray, aspect: np.ndarray, n: np.ndarray, planes: np.ndarray, eaves: float, flat_deg: float) -> tuple[str, float, float]:
    """(roof, pitch, ridge azimuth from north or NaN) from planes, largest first."""
    none = float("nan")
    if not len(n):
        return "unknown", none, none
    total = n.sum()
    major = n >= max(PLANE_SHARE * total, 6)
    flat, sloped = major & (slope < flat_deg), np.flatnonzero(major & (slope >= flat_deg))
    if n[flat].sum() >= FLAT_SHARE * total or not len(sloped):
        some = sloped if len(sloped) else np.flatnonzero(flat)
        return "flat", float(np.average(slope[some], weights=n[some])) if len(some) else none, none
    pitch = float(np.average(slope[sloped], weights=n[sloped]))
    pairs = [(n[i] + n[j], -i, -j) for k, i in enumerate(sloped) for j in sloped[k + 1 :] if gap_deg(aspect[i], aspect[j]) >= OPPOSITE_DEG]
    if pairs:
        _, i, j = max(pairs)
        run = planes[-i, :2] - planes[-j, :2]  # the planes are as high along what is at right angles to this
        ridge = float(np.degrees(np.arctan2(-run[1], run[0])) % 180)
    else:
        ridge = float((aspect[sloped[0]] + 90) % 180)
    ways = [f for f in facings(aspect[sloped], n[sloped].astype(float)) if f[1] >= FACING_SHARE * n[sloped].sum()]
    if len(ways) <= 1:
        return "shed", pitch, ridge
    if len(ways) >= 3 and eaves >= HIP_EAVES:
        return "hip", pitch, ridge
    two = gap_deg(ways[0][0], ways[1][0]) >= OPPOSITE_DEG
    if two and (len(ways) == 2 or ways[0][1] + ways[1][1] >= GABLE_SHARE * n[sloped].sum()):
        return "gable", pitch, ridge
    return "complex", pitch, ridge


def roof_planes(points: DataFrame, threshold: float = 0.18, least: int = 12, most: int = 12, trials: int = 150) -> DataFrame:
    """Planes of each building's roof points (building_id, x, y, h), largest first: slope, facing, inliers, their share, and the RMS distance.

    Random triples near each other, seeded by the building's id, propose planes;
    the one with most points is refitted, and the next looks at what is left.
    Close planes are merged, and points left over join the planes beside them.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p, planes, label, _ = _planes(frame, threshold, least, most, trials)
        slope, aspect = _slopes(planes)
        rows = []
        for k in range(len(planes)):
            own = p[label == k]
            rows.append((frame["building_id"].iloc[0], k, slope[k], aspect[k], len(own), len(own) / len(p), float(np.sqrt((_off(planes[k : k + 1], own) ** 2).mean()))))
        return pd.DataFrame(rows, columns=["building_id", "plane", "slope_deg", "aspect_deg", "inliers", "share", "rmse"])

    return points.select("building_id", "x", "y", "h").groupBy("building_id").applyInPandas(run, PLANES)


def roof_models(points: DataFrame, footprints: DataFrame, flat_deg: float = 8.0, threshold: float = 0.18, least: int = 12, most: int = 12, trials: int = 150) -> DataFrame:
    """A row for each building with points: roof (flat, shed, gable, hip, complex, unknown), pitch, ridge azimuth, planes, share of points on them, RMS distance, and the share of eaves along the outline.

    points: building_id, x, y, h; footprints: building_id, ring array<struct<x,y>>
    (closed); a building without one has no eaves and can't be a hip. Null
    where nothing is known.
    """

    def run(frame: pd.DataFrame, prints: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame([], columns=[c.split()[0] for c in MODELS.split(", ")])
        p, planes, label, middle = _planes(frame, threshold, least, most, trials)
        slope, aspect = _slopes(planes)
        n = np.array([(label == k).sum() for k in range(len(planes))])
        ring = np.array([(q["x"], q["y"]) for q in prints["ring"].iloc[0]]) - middle if len(prints) and prints["ring"].iloc[0] is not None else np.zeros((0, 2))
        eaves = eave_share(ring, p, label, slope, aspect, flat_deg) if len(planes) else float("nan")
        roof, pitch, ridge = kind(slope, aspect, n, planes, eaves, flat_deg)
        on = label >= 0
        rmse = float(np.sqrt((_off(planes, p)[np.flatnonzero(on), label[on]] ** 2).mean())) if on.any() else float("nan")
        row = (frame["building_id"].iloc[0], roof, pitch, ridge, len(planes), float(on.mean()), rmse, eaves)
        return pd.DataFrame([row], columns=[c.split()[0] for c in MODELS.split(", ")])

    out = points.select("building_id", "x", "y", "h").groupBy("building_id").cogroup(footprints.select("building_id", "ring").groupBy("building_id")).applyInPandas(run, MODELS)
    return out.replace(float("nan"), None, ["pitch_deg", "ridge_deg", "rmse", "eave_share"])

"""Edge points and region growing over them.

Both growing rules follow the order of the points and the running means of a region, so they are folds in a grouped
function, one group for each tile.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudspark.functions.metrics import curvature
from cloudspark.operators.knn import knn

FEATURES = ("curv", "tx", "ty", "tz", "nx", "ny", "nz")


def features(planes: DataFrame) -> DataFrame:
    """id, curvature, tangent and normal of each point, from its plane."""
    return planes.select(
        F.col("qid").alias("id"), F.expr(curvature("")).alias("curv"), F.col("t1").alias("tx"), F.col("t2").alias("ty"), F.col("t3").alias("tz"),
        F.col("na").alias("nx"), F.col("nb").alias("ny"), F.col("nc").alias("nz"),
    )


def edge_points(points: DataFrame, planes: DataFrame, least: float) -> DataFrame:
    """Points of a curvature above ``least``, with their features."""
    return points.join(features(planes), "id").filter(F.col("curv") > least)


def _angle_between(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Angle of two vectors without direction, between 0 and a right angle, as SQL; 0 if one has no length."""
    dot = "+".join(f"{x}*{y}" for x, y in zip(a, b, strict=True))
    size = "*".join(f"sqrt({'+'.join(f'{x}*{x}' for x in v)})" for v in (a, b))
    return f"(CASE WHEN {size} = 0 THEN 0.0 ELSE acos(least(1.0, abs({dot})/nullif({size}, 0))) END)"


def similarity(a: str = "a", b: str = "o") -> dict[str, str]:
    """``dcurv``, ``abt`` and ``abn``: difference of curvatures, angles of tangents and of normals, as SQL over the features of
    two points or regions with these prefixes."""
    vector = lambda p, v: tuple(f"{p}{v}{c}" for c in "xyz")
    return {"dcurv": f"abs({a}curv-{b}curv)", "abt": _angle_between(vector(a, "t"), vector(b, "t")), "abn": _angle_between(vector(a, "n"), vector(b, "n"))}


def same_region(angle: float, distance: float | None = None, a: str = "a", b: str = "o", gap: str = "gap") -> str:
    """Whether two are of one region: the angle of tangents and, if asked for, the distance ``gap`` are below the limits."""
    near = f" AND {gap} < {distance}" if distance is not None else ""
    return f"({similarity(a, b)['abt']} < {angle}{near})"


def same_edge(curvature_limit: float, angle: float, a: str = "a", b: str = "o") -> str:
    """The rule of older revisions: difference of curvatures and angle of normals are below the limits."""
    s = similarity(a, b)
    return f"({s['dcurv']} < {curvature_limit} AND {s['abn']} < {angle})"


@dataclass
class Rule:
    k: int = 10
    angle: float = 0.3  # largest angle of tangents
    distance: float = 0.1  # largest distance of a point from a region (dynamic rule)
    min_points: int = 10
    merge_distance: float = 0.1  # largest Hausdorff distance of regions that merge
    stop_at_merge: bool = True  # as the original: the scan ends with the first merge
    curvature: float = 0.1  # largest difference of curvatures (fixed rule)
    first_only: bool = False  # fixed rule: the first revision ends with the first region
    #: Whether features (curvature, tangent, normal) of a region or point and of a point fit; by default the angle of tangents.
    fits: Callable[[np.ndarray, np.ndarray], bool] | None = None


def _angle(a: np.ndarray, b: np.ndarray, first: int = 1) -> float:
    u, v = a[first : first + 3], b[first : first + 3]
    size = math.sqrt(float(u @ u) * float(v @ v))
    return math.acos(min(1.0, abs(float(u @ v)) / size)) if size else 0.0


def _like(rule: Rule, a: np.ndarray, b: np.ndarray) -> bool:
    return rule.fits(a, b) if rule.fits else _angle(a, b) < rule.angle


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a the distance to the nearest of b, in blocks of bounded size."""
    step = max(1, (1 << 20) // max(1, len(b)))
    return np.concatenate([np.sqrt(((a[i : i + step, None] - b[None]) ** 2).sum(2).min(1)) for i in range(0, len(a), step)])


class _Region:
    def __init__(self) -> None:
        self.points: list[int] = []
        self.mean = np.zeros(7)

    def add(self, i: int, f: np.ndarray) -> None:
        self.mean = (self.mean * len(self.points) + f) / (len(self.points) + 1)
        self.points.append(i)

    def take(self, other: _Region) -> None:
        """Means meet half-way, whatever the sizes."""
        self.mean = (self.mean + other.mean) / 2
        self.points = self.points + other.points


class _PlacedRegion(_Region):
    """A region that finds its points near a place by cells as wide as the distance asked for."""

    AROUND = tuple(np.ndindex(3, 3, 3))

    def __init__(self, cells: np.ndarray) -> None:
        super().__init__()
        self.cells, self.held = cells, {}

    def add(self, i: int, f: np.ndarray) -> None:
        super().add(i, f)
        self.held.setdefault(tuple(self.cells[i]), []).append(i)

    def take(self, other: _PlacedRegion) -> None:
        super().take(other)
        for cell, points in other.held.items():
            self.held.setdefault(cell, []).extend(points)

    def around(self, j: int) -> list[int]:
        """All points of the region that are nearer to j than a cell is wide, and others."""
        x, y, z = self.cells[j] - 1
        return [i for a, b, c in self.AROUND for i in self.held.get((x + a, y + b, z + c), ())]


def grow(xyz: np.ndarray, f: np.ndarray, near: list, rule: Rule) -> list[list[int]]:
    """Breadth-first regions of like tangents; a finished region merges with like regions close to it. near: for each point
    the places of its neighbours, nearest first."""
    seen, regions = np.zeros(len(xyz), bool), []
    for i in range(len(xyz)):
        if seen[i]:
            continue
        region, queue = _Region(), deque([i])
        while queue:
            at = queue.popleft()
            if seen[at]:
                continue
            seen[at] = True
            region.add(at, f[at])
            queue.extend(j for j in near[at] if not seen[j] and _like(rule, region.mean, f[j]))
        if len(region.points) <= rule.min_points:
            continue
        own = xyz[region.points]
        like = [r for r in regions if _like(rule, region.mean, r.mean) and max(_gap(own, xyz[r.points]).max(), _gap(xyz[r.points], own).max()) < rule.merge_distance]
        for r in reversed(like):
            region.take(r)
        regions = [r for r in regions if r not in like] + [region]
        if like and rule.stop_at_merge:
            break
    return [r.points for r in regions]


def grow_dynamic(xyz: np.ndarray, f: np.ndarray, near: list, rule: Rule) -> list[list[int]]:
    """Regions take near points of like tangents; on contact with another region they go over to it."""
    seen = np.zeros(len(xyz), bool)
    # a little wider than the distance, against rounding
    cells = np.floor(xyz / (rule.distance * (1 + 1e-9) if rule.distance > 0 else 1.0))
    regions: list[_PlacedRegion] = []
    owner: dict[int, int] = {}

    def fits(r: _PlacedRegion, j: int) -> bool:
        if not r.points or not _like(rule, r.mean, f[j]):
            return False
        there = r.around(j)
        return bool(there) and _gap(xyz[[j]], xyz[there])[0] < rule.distance

    for i in range(len(xyz)):
        if seen[i]:
            continue
        region, queue, own = _PlacedRegion(cells), deque([i]), len(regions)
        region.add(i, f[i])
        owner[i] = own
        while queue:
            for j in near[queue.popleft()]:
                if not fits(region, j):
                    continue
                if j not in owner:
                    region.add(j, f[j])
                    owner[j], seen[j] = own, True
                    queue.append(j)
                elif owner[j] != own and fits(regions[owner[j]], j):
                    other = owner[j]
                    regions[other].take(region)
                    owner.update(dict.fromkeys(region.points, other))
                    region, own = _PlacedRegion(cells), other
        if len(region.points) > rule.min_points:
            regions.append(region)
        else:
            for j in region.points:
                owner.pop(j, None)
                seen[j] = False
    return [r.points for r in regions]


def grow_fixed(xyz: np.ndarray, f: np.ndarray, near: list, rule: Rule, edge: np.ndarray) -> list[list[int]]:
    """The rule of older revisions: from each point in turn, edge points that fit the point before them; nothing merges. A seed
    need not be an edge point."""

    def fits(a: np.ndarray, b: np.ndarray) -> bool:
        return rule.fits(a, b) if rule.fits else abs(a[0] - b[0]) < rule.curvature and _angle(a, b, 4) < rule.angle

    seen, regions = np.zeros(len(xyz), bool), []
    for i in range(len(xyz)):
        if seen[i]:
            continue
        seen[i] = True
        region = [i]
        for at in region:  # grows while it is read
            for j in near[at]:
                if not seen[j] and edge[j] and fits(f[at], f[j]):
                    seen[j] = True
                    region.append(j)
        if len(region) > rule.min_points:
            regions.append(region)
            if rule.first_only:
                break
    return regions


def grow_regions(edges: DataFrame, rule: Rule, how: str = "static") -> DataFrame:
    """(tile_id, region_id, id, ord) of the regions grown over points (tile_id, id, x, y, z and features) of each tile.

    Neighbours are the k nearest of the same tile, found by the search on the grid. how: ``static``, ``dynamic``, or ``fixed``,
    which takes all points and a column ``edge`` that says which of them are edge points.
    """
    near = knn(edges.select("id", *"xyz", "tile_id"), rule.k, by="tile_id").groupBy("tile_id", "qid").agg(F.array_sort(F.collect_list(F.struct("rank", "nid"))).alias("near"))
    near = near.select("tile_id", F.col("qid").alias("id"), F.transform("near", lambda x: x["nid"]).alias("near"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, tile = pdf["id"].to_numpy(), pdf["tile_id"].iloc[0]
        xyz, f = pdf[["x", "y", "z"]].to_numpy(float), pdf[list(FEATURES)].to_numpy(float)
        places = [np.searchsorted(ids, x) for x in pdf["near"]]
        if how == "fixed":
            found = grow_fixed(xyz, f, places, rule, pdf["edge"].to_numpy(bool))
        else:
            found = (grow_dynamic if how == "dynamic" else grow)(xyz, f, places, rule)
        rows = [(tile, r, int(ids[i]), o) for r, region in enumerate(found) for o, i in enumerate(region)]
        return pd.DataFrame(rows, columns=["tile_id", "region_id", "id", "ord"])

    rows = edges.join(near, ["tile_id", "id"])
    return rows.groupBy("tile_id").applyInPandas(run, "tile_id string, region_id long, id long, ord long")

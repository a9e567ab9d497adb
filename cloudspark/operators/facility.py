"""Clustering by incremental heuristic facility location, one tile at a time.

The result depends on the order of the points, so each tile is one fold in a grouped function; tiles bound its memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TINY = 1.17549435e-38


@dataclass
class Params:
    norm: str = "l2"
    fc: float = 1.0
    lam: float = 0.5
    bin: float = 0.5
    mju: float = 0.95
    power: float = 1.0
    scales: tuple[float, float, float] = (1.0, 1.0, 1.0)
    #: Facilities looked at: of 27 grid cells, of all cells within reach, or of the whole tile ("flat", as the first revision).
    candidate_mode: str = "grid"
    compat: bool = True
    #: Reach in multiples of lam, and whether its end is left out; older revisions have 3 and True.
    reach: float = 1.0
    open_end: bool = False
    #: What is added beyond lam: a power of the excess, or (older revisions, for abn) the exponent itself.
    constant_penalty: bool = False
    #: A metric of one's own instead of ``norm``, symmetric: from points a and b, dictionaries of arrays, and these settings.
    metric: Callable[[dict, dict, Params], np.ndarray] | None = None


#: Settings of older revisions; the first one has two folds that differ in how they keep their notes only.
REVISIONS = {
    "v0": {"candidate_mode": "flat", "reach": 3.0, "open_end": True, "constant_penalty": True},
    "v1": {"candidate_mode": "grid", "reach": 3.0, "open_end": True, "constant_penalty": True},
}


def revision(name: str, **settings) -> Params:
    """Settings of an older revision, with others of one's own."""
    return Params(**(REVISIONS[name] | settings))


def distances(p: Params, a: dict, b: dict) -> np.ndarray:
    """The metric between one point and many (or many and many), as NumPy; the twin of ``functions.metrics``."""
    if p.metric:
        return p.metric(a, b, p)
    dx, dy, dz = (a[c] - b[c] for c in "xyz")
    if p.norm == "l1":
        return np.abs(dx) + np.abs(dy) + np.abs(dz)
    if p.norm == "l22":
        return dx * dx + dy * dy + dz * dz
    if p.norm == "ell":
        sx, sy, sz = p.scales
        return np.sqrt((dx * sx) ** 2 + (dy * sy) ** 2 + (0 if p.compat else (dz * sz) ** 2))
    d = np.sqrt(dx * dx + dy * dy + dz * dz)
    if p.norm == "l2":
        return d
    if p.norm == "geo":
        return np.where((d < TINY) | (d < p.lam), 0.0, d - p.lam)
    with np.errstate(all="ignore"):
        h = _kernel(p.norm, a, b, d, dx, dy, dz)
    base = p.mju * h + (1 - p.mju) * d
    beyond = p.power if p.constant_penalty and p.norm == "abn" else np.maximum(d - p.lam, 0) ** p.power
    return np.where(d < TINY, 0.0, np.where(d < p.lam, base, base + p.mju * beyond))


def _kernel(name: str, a: dict, b: dict, d, dx, dy, dz):
    size = lambda q: np.sqrt(q["na"] ** 2 + q["nb"] ** 2 + q["nc"] ** 2)
    div = lambda x, y, other=0.0: np.where(y == 0, other, x / np.where(y == 0, 1, y))
    log = lambda x: np.where(x > 0, np.log(np.where(x > 0, x, 1)), -708.0)
    if name in ("abn", "dis"):
        angle = np.arccos(np.clip(div(np.abs(a["na"] * b["na"] + a["nb"] * b["nb"] + a["nc"] * b["nc"]), size(a) * size(b), 1.0), -1, 1))
        return angle if name == "abn" else np.sin(angle / 2) * d
    if name == "ablp":
        return sum(np.arcsin(np.clip(div(np.abs(dx * q["na"] + dy * q["nb"] + dz * q["nc"]), d * size(q)), -1, 1)) for q in (a, b))
    if name == "dfp":
        off = lambda u, q: div(np.abs(u["x"] * q["na"] + u["y"] * q["nb"] + u["z"] * q["nc"] + q["nw"]), size(q))
        return np.sqrt(off(a, b) ** 2 + off(b, a) ** 2)
    if name in ("ver", "hor"):
        s = sum(log(np.arccos(np.clip(div(q["nc"], size(q), 1.0), -1, 1))) for q in (a, b))
        return 0.5 * (np.abs(s) if name == "ver" else s)
    plus = lambda l: np.where(l > 0, l * log(l), 0.0)  # noqa: E731, E741
    of = {
        "lin": lambda q: div(q["l1"] - q["l2"], q["l1"]),
        "pla": lambda q: div(q["l2"] - q["l3"], q["l1"]),
        "sph": lambda q: div(q["l3"], q["l1"]),
        "omn": lambda q: np.maximum(q["l1"] * q["l2"] * q["l3"], 0) ** (1 / 3),
        "ani": lambda q: div(q["l1"] - q["l3"], q["l1"]),
        "cur": lambda q: div(q["l3"], q["l1"] + q["l2"] + q["l3"]),
        "ent": lambda q: -(plus(q["l1"]) + plus(q["l2"]) + plus(q["l3"])),
    }[name]
    return 0.5 * (of(a) + of(b)) if name == "pla" else np.abs(of(a) - of(b))


class _Numbers:
    """Numbers that come one at a time, as an array."""

    def __init__(self, values=(), kind=float) -> None:
        self.held = np.array(values, kind)
        self.n = len(self.held)

    def append(self, value) -> None:
        if self.n == len(self.held):
            self.held = np.concatenate([self.held, np.empty(max(4, self.n), self.held.dtype)])
        self.held[self.n] = value
        self.n += 1

    def values(self) -> np.ndarray:
        return self.held[: self.n]


class _Facility:
    def __init__(self, at: int, clients=(), far=()) -> None:
        self.at = at
        self.keep(clients, far)

    def keep(self, clients, far) -> None:
        self.clients, self.far = _Numbers(clients, np.int64), _Numbers(far)  # far: distance of each client


#: Columns that a metric reads; all of them if it is not named here.
READS = {n: tuple("xyz") for n in ("l1", "l2", "l22", "ell", "geo")} | {n: (*"xyz", "na", "nb", "nc") for n in ("abn", "dis")}
#: What a bound loses to rounding.
SLACK = 1e-9


class Fold:
    """State of one tile: facilities by number, and the numbers of those in each grid cell, in the order in which they opened.

    A point is compared with all facilities in reach at once. Under a metric that keeps the triangle inequality, clients nearer to
    their facility than half of the point's distance from it stay, and are not looked at: at ``far`` from a facility that is
    ``low`` away, a client is at least ``low - far`` away. For other metrics all clients of these facilities are compared.
    """

    def __init__(self, p: Params, points: dict[str, np.ndarray]) -> None:
        self._begin(p, points)
        self.low = [float(points[c].min()) for c in "xyz"]
        self.span = [float(points[c].max()) - low for c, low in zip("xyz", self.low, strict=True)]
        self.n = [max(1, math.ceil(s / p.bin)) for s in self.span]
        self.bounded = self._bounded()

    def _begin(self, p: Params, points: dict[str, np.ndarray]) -> None:
        self.p, self.points, self.cells, self.cost = p, points, {}, 0.0
        self.facilities: list[_Facility] = []
        # of each facility by number: its point, how many clients it has, their largest distance and the sum of their distances
        self.at, self.count, self.most, self.total = _Numbers(kind=np.int64), _Numbers(kind=np.int64), _Numbers(), _Numbers()
        self.reads = tuple(points) if p.metric else READS.get(p.norm, tuple(points))
        self.bounded = False

    def _bounded(self) -> bool:
        """Whether distances are bounded by the triangle inequality. Angles between planes are if no plane is missing and no two
        points, which would be 0 apart whatever their planes, lie on one place."""
        p = self.p
        if p.metric or p.norm != "abn":
            return not p.metric and p.norm in ("l1", "l2", "ell")
        size = sum(np.asarray(self.points[c], float) ** 2 for c in ("na", "nb", "nc"))
        places = np.stack([self.points[c] for c in "xyz"], axis=1)
        return 0 <= p.mju <= 1 and (p.power >= 0 or not p.constant_penalty) and bool((size > 0).all()) and len(np.unique(places, axis=0)) == len(places)

    def cell(self, i: int) -> tuple[int, int, int]:
        at = [float(self.points[c][i]) - low for c, low in zip("xyz", self.low, strict=True)]
        if self.p.candidate_mode == "flat":
            return 0, 0, 0
        if self.p.candidate_mode == "radius":  # cells at least as wide as the ball
            return tuple(int(a // (self.p.lam * self.p.reach)) for a in at)
        return tuple(int(0.99 * n * a / s) if s else 0 for a, s, n in zip(at, self.span, self.n, strict=True))

    def _row(self, i) -> dict:
        return {c: self.points[c][i] for c in self.reads}

    def metric(self, i, j) -> np.ndarray:
        return distances(self.p, self._row(i), self._row(j))

    def open(self, i: int, clients=(), far=()) -> None:
        self._put(self.cell(i), i, clients, far)

    def _put(self, cell: tuple[int, int, int], i: int, clients, far) -> None:
        self.cells.setdefault(cell, _Numbers(kind=np.int64)).append(len(self.facilities))
        self.facilities.append(_Facility(i, clients, far))
        self.at.append(i)
        for of in (self.count, self.most, self.total):
            of.append(0)
        self._measure(len(self.facilities) - 1)

    def _measure(self, f: int) -> None:
        far = self.facilities[f].far.values()
        self.count.held[f], self.most.held[f], self.total.held[f] = len(far), far.max(initial=0.0), far.sum()

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the facilities in reach, and how far they are."""
        x, y, z = self.cell(i)
        found = [f.values() for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) for c in (z - 1, z, z + 1) if (f := self.cells.get((a, b, c))) is not None]
        numbers = np.concatenate(found) if found else np.empty(0, np.int64)
        at = self.at.held[numbers]
        d = np.sqrt(sum((self.points[c][at] - self.points[c][i]) ** 2 for c in "xyz"))
        end = self.p.lam * self.p.reach
        reached = d < end if self.p.open_end else d <= end
        return numbers[reached], d[reached]

    def _least(self, to: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Of metric values at distances ``d`` the part that keeps the triangle inequality, rounded down."""
        p = self.p
        if p.norm == "abn":
            beyond = p.power if p.constant_penalty else np.maximum(d - p.lam, 0) ** p.power
            to = np.where(d < p.lam, to, to - p.mju * beyond)
        return to - SLACK * (1 + to)

    def add(self, i: int) -> None:
        """Open a facility, join the nearest one, or open one that takes clients over; whichever costs least."""
        own = float(self.points["fc"][i])
        near, d = self.near(i)
        to = np.asarray(self.metric(i, self.at.held[near]), float) if len(near) else np.empty(0)
        apart = np.where(to > 0, to, np.inf)
        first = int(apart.argmin()) if len(near) else -1
        least = float(apart[first]) if len(near) else math.inf
        whole, part, movers, of = self._offers(i, own, near, to, d)
        terms = np.where(whole < part, whole - own + to, np.where(part < whole, part - own + to, 0.0))
        again = float(np.add.accumulate(np.concatenate([[own], terms]))[-1])
        best = min(own, least, again)
        self.cost += best
        if best == least and best != own:
            f = int(near[first])
            self.facilities[f].clients.append(i)
            self.facilities[f].far.append(least)
            self.count.held[f] += 1
            self.most.held[f] = max(self.most.held[f], least)
            self.total.held[f] += least
            return
        if best == own:
            self.open(i)
            return
        moved = []
        for k in np.flatnonzero((whole < part) | ((part < whole) & np.isin(np.arange(len(near)), of))).tolist():
            f = int(near[k])
            facility = self.facilities[f]
            clients, far = facility.clients.values(), facility.far.values()
            if whole[k] < part[k]:
                moved.append([*clients, facility.at])
                cell = self.cell(facility.at)
                left = self.cells[cell].values()
                self.cells[cell] = _Numbers(left[left != f], np.int64)
                facility.keep((), ())
            else:
                go = np.isin(clients, movers[of == k])
                moved.append(clients[go])
                facility.keep(clients[~go], far[~go])
            self._measure(f)
        clients = np.concatenate(moved).astype(np.int64) if moved else np.empty(0, np.int64)
        self.open(i, clients, self.metric(i, clients) if len(clients) else ())

    def _offers(self, i: int, own: float, near: np.ndarray, to: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each facility the costs if it and all its clients move to ``i``, and if only closer clients do; these clients, and whose they are."""
        fc = np.asarray(self.points["fc"], float)[self.at.held[near]]
        whole, part = own - fc, own - to
        count = self.count.held[near]
        if self.bounded:
            low = self._least(to, d)
            goes = count * low - 2 * self.total.held[near] * (1 + SLACK) < fc - to + SLACK
            look = np.flatnonzero((count > 0) & (goes | (low < 2 * self.most.held[near])))
        else:
            look = np.flatnonzero(count)
        if self.bounded:
            whole[~goes] = np.inf
        if not len(look):
            return whole, part, look, look
        held = [self.facilities[f] for f in near[look].tolist()]
        clients, far = np.concatenate([f.clients.values() for f in held]), np.concatenate([f.far.values() for f in held])
        of = np.repeat(np.arange(len(look)), count[look])
        if self.bounded:
            seen = goes[look][of] | (far * 2 > low[look][of])
            clients, far, of = clients[seen], far[seen], of[seen]
        gains = self.metric(i, clients) - far if len(clients) else np.empty(0)
        # summed one after the other
        order = np.concatenate([np.arange(len(look)), of])
        whole[look] = np.bincount(order, np.concatenate([whole[look], gains]), len(look))
        closer = gains < 0
        part[look] = np.bincount(order, np.concatenate([part[look], np.where(closer, gains, 0.0)]), len(look))
        return whole, part, clients[closer], look[of[closer]]

    def run(self) -> np.ndarray:
        """For each point the place of its facility."""
        n = len(self.points["x"])
        if n:
            self.open(0)
            self.cost = float(self.points["fc"][0])
        for i in range(1, n):
            self.add(i)
        out = np.arange(n)
        for cell in self.cells.values():
            for f in cell.values().tolist():
                out[self.facilities[f].clients.values()] = self.facilities[f].at
        return out


COLUMNS = ("x", "y", "z", "fc", "na", "nb", "nc", "nw", "l1", "l2", "l3")


def cluster(points: DataFrame, params: Params) -> DataFrame:
    """(tile_id, id, fid) for points with tile_id, pos and the columns the metric needs; folded by pos in each tile."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "id"], kind="stable")
        data = {c: pdf[c].to_numpy(float) for c in COLUMNS if c in pdf}
        data.setdefault("fc", np.full(len(pdf), params.fc))
        own = Fold(params, data).run()
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"tile_id": pdf["tile_id"].to_numpy(), "id": ids, "fid": ids[own]})

    return points.groupBy("tile_id").applyInPandas(fold, "tile_id string, id long, fid long")

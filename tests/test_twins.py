"""The folds against plain loops over the definitions, with assignments compared one by one."""

import math
import random

import numpy as np
import pytest

from cloudspark.operators import facility, regions
from cloudspark.operators.knn import knn


def l2(p, q):
    return math.dist(p[:3], q[:3])


def off_planes(p, q):
    """Distances of each from the other's plane (normal at 3 to 5, offset at 6), mixed with the distance; lambda 0.4, mju 0.9."""
    size = lambda v: math.sqrt(v[3] ** 2 + v[4] ** 2 + v[5] ** 2)
    far = lambda u, v: abs(u[0] * v[3] + u[1] * v[4] + u[2] * v[5] + v[6]) / size(v)
    d = l2(p, q)
    if d == 0:
        return 0.0
    return 0.9 * math.hypot(far(p, q), far(q, p)) + 0.1 * d + (0.9 * (d - 0.4) if d >= 0.4 else 0)


def locate(points, costs, g, reach, width):
    """Owner of each point. Facilities are looked up by grid cell, cells in the order of x, y, z."""
    low = [min(p[i] for p in points) for i in range(3)]
    span = [max(p[i] for p in points) - low[i] for i in range(3)]
    count = [max(1, math.ceil(s / width)) for s in span]
    cell = lambda p: tuple(int(0.99 * count[i] * (p[i] - low[i]) / span[i]) for i in range(3))
    opened = [0]  # in the order of opening
    clients = {0: []}
    for n in range(1, len(points)):
        p, at = points[n], cell(points[n])
        close = [f for f in opened if all(abs(a - b) <= 1 for a, b in zip(cell(points[f]), at)) and l2(p, points[f]) <= reach]
        close.sort(key=lambda f: (cell(points[f]), opened.index(f)))
        join, taken, plans = math.inf, costs[n], []
        who = None
        for f in close:
            d = g(p, points[f])
            if 0 < d < join:
                join, who = d, f
            gain = {u: g(p, points[u]) - g(points[f], points[u]) for u in clients[f]}
            everything = costs[n] - costs[f] + sum(gain.values())
            some = costs[n] - d + sum(x for x in gain.values() if x < 0)
            if everything < some:
                taken += everything - costs[n] + d
                plans.append((f, [*clients[f], f]))
            elif some < everything:
                taken += some - costs[n] + d
                plans.append((f, [u for u in clients[f] if gain[u] < 0]))
        cheapest = min(costs[n], join, taken)
        if cheapest == join and join < costs[n]:
            clients[who].append(n)
            continue
        opened.append(n)
        clients[n] = []
        if cheapest < costs[n]:
            for f, moved in plans:
                clients[n] += moved
                clients[f] = [u for u in clients[f] if u not in moved]
                if f in moved:
                    opened.remove(f)
                    del clients[f]
    owner = {f: f for f in opened}
    owner.update((u, f) for f, own in clients.items() for u in own)
    return [owner[n] for n in range(len(points))]


@pytest.mark.parametrize("norm, g", [("l2", l2), ("dfp", off_planes)])
@pytest.mark.parametrize("seed, cost, reach", [(1, 0.3, 0.4), (2, 0.05, 0.25), (3, 1.0, 0.6), (4, 0.15, 0.4)])
def test_fold_assigns_as_the_definition(norm, g, seed, cost, reach):
    rng = random.Random(seed)
    points = [[rng.random() for _ in range(3)] + [rng.uniform(-1, 1) for _ in range(3)] + [rng.random()] for _ in range(150)]
    points[70] = list(points[20])  # coincident points
    names = ("x", "y", "z", "na", "nb", "nc", "nw")
    data = {c: np.array([p[i] for p in points]) for i, c in enumerate(names)} | {"fc": np.full(150, cost)}
    p = facility.Params(norm=norm, fc=cost, lam=0.4 if norm == "dfp" else reach, bin=reach, mju=0.9)
    want = locate(points, [cost] * 150, g, p.lam, reach)
    assert facility.Fold(p, data).run().tolist() == want
    assert 1 < len(set(want)) < 150


def turn(a, b):
    """Angle between the tangents of two features, without direction."""
    u, v = a[1:4], b[1:4]
    return math.acos(min(1.0, abs(sum(x * y for x, y in zip(u, v))) / math.hypot(*u) / math.hypot(*v)))


def far_apart(xyz, a, b):
    return max(max(min(math.dist(xyz[i], xyz[j]) for j in t) for i in s) for s, t in ((a, b), (b, a)))


def static_regions(xyz, f, near, rule):
    left, done = set(range(len(xyz))), []
    for seed in range(len(xyz)):
        if seed not in left:
            continue
        own, line = [], [seed]
        while line:
            at, line = line[0], line[1:]
            if at in left:
                left.remove(at)
                own.append(at)
                mean = [sum(f[i][k] for i in own) / len(own) for k in range(7)]
                line += [j for j in near[at] if j in left and turn(mean, f[j]) < rule.angle]
        if len(own) > rule.min_points:
            mean = [sum(f[i][k] for i in own) / len(own) for k in range(7)]
            merged = [r for r in done if turn(mean, r[1]) < rule.angle and far_apart(xyz, own, r[0]) < rule.merge_distance]
            done = [r for r in done if r not in merged]
            for points, other in merged[::-1]:
                own, mean = own + points, [(a + b) / 2 for a, b in zip(mean, other)]
            done.append((own, mean))
            if merged and rule.stop_at_merge:
                break
    return [r for r, _ in done]


def fixed_regions(xyz, f, near, rule, edge):
    left, done = set(range(len(xyz))), []
    for seed in range(len(xyz)):
        own, line = [], [seed]
        while line:
            at = line.pop(0)
            if at in left:
                left.remove(at)
                own.append(at)
                tilt = lambda i, j: math.acos(min(1.0, abs(sum(a * b for a, b in zip(f[i][4:], f[j][4:]))) / math.hypot(*f[i][4:]) / math.hypot(*f[j][4:])))
                line += [j for j in near[at] if j in left and edge[j] and abs(f[at][0] - f[j][0]) < rule.curvature and tilt(at, j) < rule.angle]
        if len(own) > rule.min_points:
            done.append(own)
            if rule.first_only:
                break
    return done


def surfaces(seed, n=120):
    rng = np.random.default_rng(seed)
    xyz = np.concatenate([rng.random((n // 2, 3)) * [1, 0.05, 0.05], rng.random((n // 2, 3)) * [0.05, 1, 0.05] + [0, 0, 0.08]])
    f = np.concatenate([rng.random((n, 1)) * 0.2, np.repeat([[1, 0, 0], [0, 1, 0]], n // 2, 0) + rng.normal(0, 0.25, (n, 3)), rng.normal(size=(n, 3))], 1)
    return xyz, f


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("stop", [True, False])
def test_regions_grow_as_the_definition(spark, seed, stop):
    xyz, f = surfaces(seed)
    rule = regions.Rule(k=6, angle=0.5, min_points=2, merge_distance=0.6, stop_at_merge=stop)
    near = [sorted(range(len(xyz)), key=lambda j, i=i: (((xyz[i] - xyz[j]) ** 2).sum(), j))[:6] for i in range(len(xyz))]
    want = static_regions(xyz.tolist(), f.tolist(), near, rule)
    assert regions.grow(xyz, f, near, rule) == want and len(want) > (not stop)
    if seed == 1:
        names = ["tile_id", "id", "x", "y", "z", *regions.FEATURES]
        rows = [("t", i, *map(float, xyz[i]), *map(float, f[i])) for i in range(len(xyz))] + [("u", 1000, 0.0, 0.0, 0.0, *[1.0] * 7)]
        found: dict = {}
        for r in regions.grow_regions(spark.createDataFrame(rows, names), rule).orderBy("region_id", "ord").collect():
            found.setdefault(r.region_id, []).append(r.id)
        assert list(found.values()) == want


@pytest.mark.parametrize("first", [True, False])
def test_fixed_rule_of_older_revisions(first):
    xyz, f = surfaces(4)
    rule = regions.Rule(k=8, angle=1.0, curvature=0.1, min_points=3, first_only=first)
    near = [sorted(range(len(xyz)), key=lambda j, i=i: (((xyz[i] - xyz[j]) ** 2).sum(), j))[:8] for i in range(len(xyz))]
    edge = f[:, 0] > 0.05
    want = fixed_regions(xyz.tolist(), f.tolist(), near, rule, edge)
    assert [sorted(r) for r in regions.grow_fixed(xyz, f, near, rule, edge)] == [sorted(r) for r in want] and want


def test_functions_in_place_of_names():
    rng = np.random.default_rng(2)
    data = {c: rng.random(80) for c in "xyz"} | {"fc": np.full(80, 0.2)}
    named = facility.Fold(facility.Params(norm="l1", lam=0.4, bin=0.4), data).run()
    own = facility.Params(lam=0.4, bin=0.4, metric=lambda a, b, p: sum(np.abs(a[c] - b[c]) for c in "xyz"))
    assert (facility.Fold(own, data).run() == named).all()
    xyz, f = surfaces(5)
    near = [list(range(max(0, i - 3), min(len(xyz), i + 4))) for i in range(len(xyz))]
    rule = {"k": 7, "angle": 0.5, "min_points": 2}
    by_rule = regions.grow(xyz, f, near, regions.Rule(**rule, fits=lambda a, b: turn(a, b) < 0.5))
    assert by_rule == regions.grow(xyz, f, near, regions.Rule(**rule))


def test_neighbours_of_a_tile_stay_in_it(spark):
    rows = [(i, float(i % 2) * 1e-3, float(i), 0.0, f"t{i % 2}") for i in range(20)]
    found = knn(spark.createDataFrame(rows, "id long, x double, y double, z double, tile_id string"), 3, by="tile_id").collect()
    assert len(found) == 60 and all(r.qid % 2 == r.nid % 2 and r.tile_id == f"t{r.qid % 2}" for r in found)


def test_dynamic_growth_looks_near_places_only():
    """Growth by cells equals growth by distances to all points of a region, also where coordinates lie on cell borders."""
    rng = np.random.default_rng(31)
    for step in (None, 0.1):
        xyz = rng.random((260, 3)) * [1, 1, 0.1]
        xyz = xyz if step is None else np.round(xyz / step) * step + rng.choice([0, 1e-3], (260, 1))
        f = rng.normal(0, 0.02, (260, 7)) + [0, 1, 0, 0, 0, 0, 1]
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
        near = [list(np.lexsort((np.arange(260), row))[:12]) for row in d]
        for reach in (0.05, 0.1, 0.25, np.inf, 0.0):
            rule = regions.Rule(distance=reach)
            got, placed = regions.grow_dynamic(xyz, f, near, rule), regions._PlacedRegion.around
            try:
                regions._PlacedRegion.around = lambda r, j: r.points
                assert got == regions.grow_dynamic(xyz, f, near, rule)
            finally:
                regions._PlacedRegion.around = placed
            assert reach < 0.1 or len(got) > 0


def test_fold_looks_at_few_clients(monkeypatch):
    """Four times the points on the same room: values of the metric grow with the facilities in reach, not with their clients."""
    values = {}
    measure = facility.distances

    def counted(p, a, b):
        out = measure(p, a, b)
        values[n] = values.get(n, 0) + out.size
        return out

    monkeypatch.setattr(facility, "distances", counted)
    for n in (1000, 4000):
        rng = np.random.default_rng(8)
        data = {c: rng.normal(0, 0.125, n) for c in "xyz"} | {"fc": np.full(n, 1.0)}
        own = facility.Fold(facility.Params(norm="l2", lam=0.5, bin=0.5), data).run()
        assert (own[own] == own).all()
    assert values[4000] < 9 * values[1000]


def test_fold_with_points_on_one_place_and_missing_planes():
    """Where the triangle inequality fails no client is passed over."""
    rng = np.random.default_rng(9)
    data = {c: rng.integers(0, 3, 90) / 4 for c in "xyz"} | {c: rng.normal(0, 1, 90) for c in ("na", "nb", "nc")} | {"fc": np.full(90, 0.5)}
    data["na"][:4] = data["nb"][:4] = data["nc"][:4] = 0.0
    fold = facility.Fold(facility.Params(norm="abn", lam=0.6, bin=0.6), data)
    assert not fold.bounded
    own = fold.run()
    clients = np.flatnonzero(own != np.arange(90))
    rows = [{c: v[i] for c, v in data.items()} for i in (own[clients], clients)]
    assert abs(0.5 * (own == np.arange(90)).sum() + facility.distances(fold.p, *rows).sum() - fold.cost) < 1e-9

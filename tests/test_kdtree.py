"""Trees of boxes: tiles by count, neighbours and distances of regions by bounds."""

import numpy as np

from cloudspark.operators import kdtree

CLOUD = "id long, x double, y double, z double"


def stack_tiles(rows, most):
    """Tiles by a stack, as the definition says."""
    out, stack, made, order = {}, [(0, 0, rows)], 1, 0
    while stack:
        number, depth, own = stack.pop()
        turn = depth % 3
        keys = [lambda r, i=i: r[1 + (turn + i) % 3] for i in range(3)] + [lambda r: r[0]]
        key = next((k for k in keys if len({k(r) for r in own}) > 1), None)
        if len(own) <= most or key is None:
            out |= {r[0]: (f"tile_{number}_{depth}_{turn}", order) for r in own}
            order += 1
            continue
        cut, top = float(np.median([key(r) for r in own])), max(key(r) for r in own)
        above = [r for r in own if key(r) > cut or (cut == top and key(r) == cut)]
        below = [r for r in own if r not in above]
        stack += [(made, depth + 1, below), (made + 1, depth + 1, above)]
        made += 2
    return out


def test_tiles_stop_by_count(spark):
    rng = np.random.default_rng(11)
    spread = [(i, *map(float, np.round(rng.random(3), 1))) for i in range(200)]
    dense = [(200 + i, 0.5, 0.5, 0.5) for i in range(90)] + [(290 + i, *map(float, rng.normal(5, 0.01, 3))) for i in range(60)]
    rows = spread + dense
    frame = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(rows)], f"{CLOUD}, g int").repartition(3)
    for most in (1000, 50, 7):
        got = {r.id: (r.tile_id, r.tile_ord) for r in kdtree.tiles(frame, most).collect()}
        assert got == stack_tiles(rows, most)
        assert max(np.unique([t for t, _ in got.values()], return_counts=True)[1]) <= most or most == 1000
    again = kdtree.tiles(frame, 50)
    assert again.columns == ["id", "x", "y", "z", "g", "tile_id", "tile_ord"] and {(r.id, r.g) for r in again.collect()} == {(r[0], i % 7) for i, r in enumerate(rows)}
    assert kdtree.tiles(frame.limit(0), 5).count() == 0


def brute_neighbours(points, queries, k):
    at = np.array([r[1:4] for r in points])
    ids = np.array([r[0] for r in points])
    out = set()
    for q in queries:
        d2 = (q[1] - at[:, 0]) ** 2 + (q[2] - at[:, 1]) ** 2 + (q[3] - at[:, 2]) ** 2
        out |= {(q[0], int(ids[i]), n + 1) for n, i in enumerate(np.lexsort((ids, d2))[:k])}
    return out


def test_neighbours_of_dense_and_far_places(spark):
    rng = np.random.default_rng(12)
    dense = [(i, *map(float, rng.normal(0, 0.01, 3))) for i in range(3000)]
    same = [(3000 + i, 7.0, 7.0, 7.0) for i in range(40)]
    queries = [(i, *map(float, 50 * rng.normal(0, 1, 3))) for i in range(30)] + [(100 + i, *dense[i][1:]) for i in range(20)] + [(200, 7.0, 7.0, 7.0), (201, 7.1, 7.0, 7.0)]
    points, asked = spark.createDataFrame(dense + same, CLOUD).repartition(3), spark.createDataFrame(queries, CLOUD)
    for k in (1, 10, 60):
        got = {(r.qid, r.nid, r["rank"]) for r in kdtree.knn(points, k, asked).collect()}
        assert got == brute_neighbours(dense + same, queries, k)
    few = spark.createDataFrame(dense[:3], CLOUD)
    assert {(r.qid, r.nid, r["rank"]) for r in kdtree.knn(few, 5, asked).collect()} == brute_neighbours(dense[:3], queries, 5)
    assert kdtree.knn(points.limit(0), 5, asked).count() == 0 == kdtree.knn(points, 5, asked.limit(0)).count()


def test_a_search_reads_few_leaves(spark, monkeypatch):
    """The points that a query is compared with stay within a constant times k as the cluster it is far from grows."""
    rng = np.random.default_rng(13)
    queries = spark.createDataFrame([(i, *map(float, 50 * rng.normal(0, 1, 3))) for i in range(40)], CLOUD)
    read, write = [], kdtree.materialize

    def noted(frame, tag):
        out = write(frame, tag)
        if tag == "boxes":
            read.append(out.selectExpr("sum(n) / count(DISTINCT struct(qx, qy, qz))").first()[0])
        return out

    monkeypatch.setattr(kdtree, "materialize", noted)
    for n in (1000, 20_000):
        points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.normal(0, 0.1, (n, 3)))], CLOUD)
        kdtree.knn(points, 20, queries).count()
    assert read[1] < 20 * 20 and read[1] < 2 * read[0]


def test_regions(spark):
    rng = np.random.default_rng(14)
    places = {r: rng.normal(r * (r % 3), 0.3, (n, 3)) for r, n in enumerate((150, 80, 200, 1, 40))}
    rows = [(i, *map(float, x), r) for r, own in places.items() for i, x in enumerate(own)]
    frame = spark.createDataFrame(rows, f"{CLOUD}, region long")
    found = kdtree.region_distances(frame, leaf=8)
    got = {(r.ra, r.rb): (r.h, r.gap) for r in found.collect()}
    assert len(got) == 20
    for (a, b), (h, gap) in got.items():
        d = np.sqrt(((places[a][:, None] - places[b][None]) ** 2).sum(2)).min(1)
        assert np.isclose(h, d.max()) and np.isclose(gap, d.min())
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bounded_searches(spark):
    """Neighbours within a radius, and distances within a factor of the true ones from fewer leaves."""
    rng = np.random.default_rng(15)
    rows = [(i, *map(float, x)) for i, x in enumerate(rng.normal(0, 1, (4000, 3)))]
    queries = rows[:60] + [(9000, 8.0, 8.0, 8.0)]
    points, asked = spark.createDataFrame(rows, CLOUD), spark.createDataFrame(queries, CLOUD)
    at = {r[0]: np.array(r[1:]) for r in [*rows, queries[-1]]}
    for radius in (0.6,):
        got = {(r.qid, r.nid, r["rank"]) for r in kdtree.knn(points, 12, asked, radius=radius).collect()}
        assert got == {(q, n, r) for q, n, r in brute_neighbours(rows, queries, 12) if ((at[q] - at[n]) ** 2).sum() < radius * radius}
    exact, near = ({(r.qid, r["rank"]): r for r in kdtree.knn(points, 12, asked, eps=eps, count_leaves=True).collect()} for eps in (0.0, 1.0))
    assert exact.keys() == near.keys() and len(exact) == 12 * 61
    assert all(exact[x].d2 <= near[x].d2 <= 4 * exact[x].d2 + 1e-12 for x in exact)
    read = [sum(r.leaves for r in found.values()) for found in (exact, near)]
    assert read[1] < 0.6 * read[0]


def test_queries_of_a_task_are_bounded(spark, monkeypatch):
    """However small the table of queries is, the descent is cut into tasks of some QUERIES places each, with the same neighbours."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(0, 1, (400, 3)))], "id long, x double, y double, z double")
    whole = sorted(map(tuple, kdtree.knn(points, 4).select("qid", "nid", "rank").collect()))
    monkeypatch.setattr(kdtree, "QUERIES", 50)
    tasks, kept = [], kdtree.materialize

    def written(frame, tag):
        if tag == "boxes":
            tasks.append(frame.select(F.spark_partition_id().alias("p")).groupBy("p").count().count())
        return kept(frame, tag)

    monkeypatch.setattr(kdtree, "materialize", written)
    assert sorted(map(tuple, kdtree.knn(points, 4).select("qid", "nid", "rank").collect())) == whole
    assert tasks and tasks[0] == 8

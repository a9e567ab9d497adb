"""The saved index after batches of insertions and removals is the one made of the points that are left."""

import numpy as np

from cloudspark.operators.neighbour_index import NeighbourIndex
from test_kdtree import CLOUD, brute_neighbours


def found(index, asked, k, **more):
    return {(r.qid, r.nid, r["rank"]) for r in index.knn(asked, k, **more).collect()}


def test_insertions_and_removals(spark, tmp_path):
    rng = np.random.default_rng(21)
    frame = lambda rows: spark.createDataFrame(rows, CLOUD)
    rows = [(i, *map(float, x)) for i, x in enumerate(rng.normal(0, 1, (1200, 3)))]
    same = [(5000 + 3 * i, 0.5, 0.5, 0.5) for i in range(200)]  # a place with more points than a leaf
    queries = [*rows[:25], same[0], (9000, 8.0, 8.0, 8.0)]
    asked = frame(queries)
    index = NeighbourIndex.create(spark, f"file://{tmp_path}/index")
    assert not found(index, asked, 3) and index.remove(asked).version == index.version
    live = {}
    for batch in (rows[:700], rows[700:800] + same, rows[800:]):
        index = index.insert(frame(batch))
        live |= {r[0]: r for r in batch}
    assert [t["live"] for t in index.trees] == [1400] or sum(t["live"] for t in index.trees) == 1400
    assert found(index, asked, 7) == brute_neighbours(list(live.values()), queries, 7)
    before = index.version

    for gone in ([r[0] for r in rows[::9]] + [s[0] for s in same[:60]] + [77_777], [r[0] for r in rows[1::9]]):
        index = index.remove(spark.createDataFrame([(g,) for g in gone], "id long"))
        live = {i: r for i, r in live.items() if i not in set(gone)}
        assert found(index, asked, 7) == brute_neighbours(list(live.values()), queries, 7)
    back = [rows[0], rows[9], same[3]]
    index = index.insert(frame(back))
    live |= {r[0]: r for r in back}
    assert len(index.trees) > 1

    for t in index.trees:  # as a session that has not seen the tables
        spark.sql(f"DROP TABLE {t['points']}")
    again = NeighbourIndex.open(spark, f"file://{tmp_path}/index")
    assert again.version == index.version and {r.id for r in again.points().collect()} == set(live)
    for k in (1, 50):
        assert found(again, asked, k) == brute_neighbours(list(live.values()), queries, k)
    near = {(q, n, r) for q, n, r in brute_neighbours(list(live.values()), queries, 9) if sum((a - b) ** 2 for a, b in zip(dict((x[0], x) for x in queries)[q][1:], live[n][1:], strict=True)) < 0.16}
    assert found(again, asked, 9, radius=0.4) == near
    assert len(NeighbourIndex.open(spark, f"file://{tmp_path}/index", before).points().collect()) == 1400

    most = spark.createDataFrame([(i,) for i in sorted(live)[: len(live) - 5]], "id long")
    few = again.remove(most)
    assert len(again.trees) > 1 and [t["built"] for t in few.trees] == [5] and {r.id for r in few.points().collect()} == set(sorted(live)[-5:])
    none = few.remove(few.points().select("id"))
    assert not none.trees and not found(none, asked, 3)


def test_trees_that_are_built_again_together(spark, tmp_path):
    rng = np.random.default_rng(23)
    rows = [(i, *map(float, x)) for i, x in enumerate(rng.random((160, 3)))]
    index = NeighbourIndex.create(spark, f"file://{tmp_path}/index")
    for batch in (rows[:100], rows[100:]):
        index = index.insert(spark.createDataFrame(batch, CLOUD))
    assert len(index.trees) == 2
    left = [r for r in rows if r[0] % 3 == 0]
    index = index.remove(spark.createDataFrame([(r[0],) for r in rows if r[0] % 3], "id long"))
    assert len(index.trees) == 1 and found(index, spark.createDataFrame(rows[:20], CLOUD), 40) == brute_neighbours(left, rows[:20], 40)


def test_points_stay_where_they_are(spark, tmp_path):
    rng = np.random.default_rng(22)
    rows = [(i, *map(float, x)) for i, x in enumerate(rng.random((500, 3)))]
    index = NeighbourIndex.create(spark, f"file://{tmp_path}/index").insert(spark.createDataFrame(rows, CLOUD))
    boxes = index._nodes(index.trees[0]).select("path", "n").repartition(3)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.read_leaves(boxes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    indexed = plan[plan.index("SortMergeJoin") :].split("+- ")[-4:]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and not any("Exchange" in x for x in indexed[1:]), plan

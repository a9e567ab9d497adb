import random

import numpy as np
import pytest

from cloudspark.functions import metrics
from cloudspark.operators import facility, regions, tiling
from cloudspark.operators.knn import knn
from cloudspark.sources import points as source, sinks


def cloud(n=60, seed=1):
    rng = np.random.default_rng(seed)
    out = {c: rng.random(n) for c in ("x", "y", "z", "na", "nb", "nc", "nd")}
    l = np.sort(rng.random((n, 3)), 1)[:, ::-1]  # noqa: E741
    return out | {"nw": out.pop("nd"), "l1": l[:, 0], "l2": l[:, 1], "l3": l[:, 2], "fc": np.full(n, 0.3)}


@pytest.mark.parametrize("name", metrics.NAMES)
def test_column_metric_equals_its_numpy_twin_and_is_symmetric(spark, name):
    from pyspark.sql import functions as F

    p = facility.Params(norm=name, lam=0.4, mju=0.9, power=1.0)
    data = cloud()
    rows = [{f"{k}{c}": float(v[i + d]) for c, v in data.items() for k, d in (("a", 0), ("o", 1))} for i in range(59)]
    df = spark.createDataFrame(rows)
    e = metrics.metric(name, lam=0.4, mju=0.9)
    got = [r[0] for r in df.select(F.expr(e)).collect()]
    a, b = ({c: v[i : 59 + i] for c, v in data.items()} for i in (0, 1))
    assert np.allclose(got, facility.distances(p, a, b))
    assert np.allclose(facility.distances(p, a, b), facility.distances(p, b, a))
    if name not in ("hor", "ver"):
        assert np.allclose(facility.distances(p, a, a), 0)


@pytest.mark.parametrize("norm", ["l2", "dfp", "abn"])
@pytest.mark.parametrize("mode", ["grid", "radius"])
def test_fold_accounts_for_its_cost(norm, mode):
    p = facility.Params(norm=norm, lam=0.4, bin=0.4, candidate_mode=mode)
    data = cloud(120, 3)
    fold = facility.Fold(p, data)
    own = fold.run()
    assert (own[own] == own).all()  # each point is a facility or the client of one
    clients = np.flatnonzero(own != np.arange(120))
    rows = [{c: v[i] for c, v in data.items()} for i in (own[clients], clients)]
    cost = 0.3 * (own == np.arange(120)).sum() + facility.distances(p, *rows).sum()
    assert abs(cost - fold.cost) < 1e-6


def test_knn_equals_brute_force(spark):
    random.seed(2)
    xyz = [(i, random.choice([0.0, 1.0, random.random() * 9]), random.random(), random.random()) for i in range(200)]
    df = spark.createDataFrame(xyz, "id long, x double, y double, z double")
    got = {}
    for r in knn(df, 5).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.nid
    for i, *p in xyz:
        want = sorted(((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, *q in xyz))[:5]
        assert [got[i][k] for k in range(1, 6)] == [j for _, j in want]


def test_knn_of_few_and_of_no_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert sorted((r.qid, r.nid) for r in knn(df, 9).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert knn(df.limit(0), 3).count() == 0


def test_parser_skips_odd_rows_but_counts_their_lines(spark):
    lines = ["1 2 3", "", "1 2", "\t4  5 6 ", "a b c", "7 1 2 3 9 8 7 6"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, value string")
    assert sorted(r.id for r in source.parse_points(df).collect()) == [0, 3, 7]


def test_tiles_are_even(spark):
    df = spark.createDataFrame([(i, random.random(), random.random(), random.random()) for i in range(128)], "id long, x double, y double, z double")
    assert {r["count"] for r in tiling.kd_tiles(df, tiling.levels_for(128, 16)).groupBy("tile").count().collect()} == {16}


def nearest(xyz, k):
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    return [sorted(range(len(xyz)), key=lambda j: (row[j], j))[:k] for row in d]


def test_regions_follow_lines():
    t = np.linspace(0, 1, 40)
    xyz = np.concatenate([np.column_stack([t, t * 0, t * 0]), np.column_stack([t * 0, t, t * 0 + 5])])
    f = np.zeros((80, 7))
    f[:40, 1] = f[40:, 2] = 1
    rule = regions.Rule(k=4, angle=0.3, distance=0.2)
    for by in (regions.grow, regions.grow_dynamic):
        assert sorted(sorted(r) for r in by(xyz, f, nearest(xyz, 4), rule)) == [list(range(40)), list(range(40, 80))]


def test_knn_of_crowded_places_groups_and_queries_outside(spark):
    rng = random.Random(8)
    spots = [(0.0, 0.0, 0.0)] * 60 + [(1e-9 * rng.random(), 0.0, 1e-9) for _ in range(40)] + [(rng.random() * 100, rng.random(), rng.gauss(0, 1e3)) for _ in range(60)]
    points = [(i, *s, i % 3) for i, s in enumerate(spots)]
    asked = [(1000 + i, *s, i % 4) for i, s in enumerate([(0.0, 0.0, 0.0), (-500.0, 3.0, 9e4), (50.0, 0.5, 0.0), (1e-9, 0.0, 1e-9)] * 4)]
    names = "id long, x double, y double, z double, tile long"
    p, q = spark.createDataFrame([*points, (999, None, 1.0, 1.0, 0)], names), spark.createDataFrame(asked, names)

    def brute(queries, by):
        out = {}
        for i, *at, g in queries:
            near = sorted((sum((a - b) ** 2 for a, b in zip(at, spot)), j) for j, *spot, h in points if not by or g == h)
            out[i] = [j for _, j in near[:7]]
        return {i: x for i, x in out.items() if x}

    for by in (None, "tile"):
        for queries, table in ((points, None), (asked, q)):
            got = {}
            for r in knn(p, 7, table, by).collect():
                got.setdefault(r.qid, {})[r["rank"]] = r.nid
            assert {i: [x[k] for k in sorted(x)] for i, x in got.items()} == brute(queries, by)


def test_medians_from_histograms(spark):
    rng = np.random.default_rng(4)
    values = {1: rng.random(1001), 2: rng.normal(size=1000), 3: np.repeat([1.0, 2.0], 500), 4: np.array([7.0]), 5: np.concatenate([np.zeros(600), rng.random(400) * 1e-12])}
    table = spark.createDataFrame([(t, float(v)) for t, x in values.items() for v in x], "tile long, x double")
    for rows in (1 << 20, 10):
        assert {r.tile: r.cut for r in tiling.medians(table, "x", exact_rows=rows).collect()} == {t: float(np.median(x)) for t, x in values.items()}


def test_plan_of_tiles_grows_with_the_levels(spark):
    df = spark.createDataFrame([(i, random.random(), random.random(), random.random()) for i in range(64)], "id long, x double, y double, z double")
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df.write.mode("overwrite").parquet(f"{path}/few")
    scans = [tiling.kd_tiles(spark.read.parquet(f"{path}/few"), n)._jdf.queryExecution().optimizedPlan().toString().count("Relation") for n in (2, 4, 6)]
    assert scans == [3, 5, 7]


def test_numbered_lines_of_many_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(2_000)))
    (tmp_path / "b.txt").write_text("one\r\ntwo\n\nfour")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = source.read_lines(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"])
        assert rows.rdd.getNumPartitions() > 5
        got = {(r.path.rsplit("/", 1)[-1], r.pos): r.value for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.txt", i): f"line {i} {'x' * (i % 50)}" for i in range(2_000)} | {("b.txt", i): x for i, x in enumerate(["one", "two", "", "four"])}


def test_tile_lists(spark, tmp_path):
    """Seven columns; ids that are unique over the tiles; lists that are written and read again."""
    for t in range(3):
        (tmp_path / f"cloud_{t}_1_1").write_text("".join(f"{t}.{i} {i} 0 0.5 1 2 3\n" for i in range(10)) + "bad row\n")
    (tmp_path / "cloud.list").write_text("cloud_2_1_1\ncloud_0_1_1\n\ncloud_1_1_1\n")
    got = source.read_tiles(spark, f"{tmp_path}/cloud.list", non_uniform=True).collect()
    assert {(r.tile_id, r.id, r.x, r.fc, r.r) for r in got} == {(f"cloud_{t}_1_1", 11 * k + i, float(f"{t}.{i}"), 0.5, 1) for k, t in enumerate((2, 0, 1)) for i in range(10)}
    sinks.write_tiles(spark.createDataFrame(got), f"{tmp_path}/out", "again")
    again = source.read_tiles(spark, f"{tmp_path}/out/again.list", non_uniform=True).collect()
    assert {(r.tile_id, r.id, r.x, r.y, r.fc) for r in again} == {(r.tile_id, r.id, r.x, r.y, r.fc) for r in got}


def test_rows_with_bad_tokens_are_kept_aside(spark):
    df = spark.createDataFrame(list(enumerate(["1 2 3", "1 x 3", "1 2", "1 2 3 z"])), "pos long, value string")
    assert [r.pos for r in source.bad_rows(df).collect()] == [1, 3] and [r.id for r in source.parse_points(df).collect()] == [0]
    with pytest.raises(Exception, match="(?i)cast"):
        source.parse_points(df, strict=True).collect()


def test_clusters_over_blocks_of_lines(spark):
    text = ["# note", "5 6", "1: x", "2 3", "", "4", "bad: y", "5", "9:", *map(str, range(20, 40))]
    df = spark.createDataFrame(list(enumerate(text)), "pos long, value string")
    whole = sorted(map(tuple, source.parse_clusters(df).collect()))
    assert whole == sorted(map(tuple, source.parse_clusters(df, block_lines=2).collect()))
    assert (1, 3, 4) in whole and (9, 20, 39) in whole and all(c != 0 for c, _, _ in whole)


def test_registry_is_complete():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60


def test_grid_by_count_has_its_own_number_of_bins(spark, tmp_path):
    import __spark_entry__ as e

    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.random(11)], i % 10) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = np.array([r[1][:3] for r in rows], np.float32).astype(float)
    low, high = at.min(0), at.max(0)
    want = np.floor((at - low) / (high - low) * (0.99 * np.array([7, 4, 3]))).astype(int).tolist()
    got = {r.id: r for r in e.queries()["grid_by_count"](spark, str(tmp_path)).collect()}
    assert len(got) == 300 and all([got[i].ix, got[i].iy, got[i].iz] == want[i] and got[i].cell == want[i][0] + 7 * want[i][1] + 28 * want[i][2] for i in range(300))


def test_facilities_in_reach_are_not_all_joined(spark, monkeypatch):
    """Nearest facilities and overlaps, held to all pairs; the pairs within the reach, which grow with the square of a cloud, are not made."""
    from cloudspark.operators import stats

    def refuse(*_):
        raise AssertionError("all pairs in reach")

    monkeypatch.setattr(stats, "radius_join", refuse, raising=False)
    rng = np.random.default_rng(6)
    # a lattice, with ties, a dense cloud, copies and points out of reach
    xyz = np.concatenate([rng.integers(0, 4, (60, 3)) / 3, rng.normal(0.5, 0.02, (60, 3)), [[9.0, 9.0, 9.0], [-9.0, 0.0, 0.0], [-9.0, 0.1, 0.0]], np.full((8, 3), 0.25)])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    far = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    for reach in (0.05, 0.7, 30.0):
        want = {}
        for i in range(len(xyz)):
            d, f = min((far[i, f], f) for f in range(0, len(xyz), 5))
            if d <= reach:
                want[i] = (f, d)
        found = stats.nearest_facility(points, points.filter("id % 5 = 0"), reach).collect()
        assert {r.id: (r.fid, pytest.approx(r.d, abs=1e-12)) for r in found} == want
        assigned = spark.createDataFrame([(i, f) for i, (f, _) in want.items()], "id long, fid long")
        rad = {}
        for i, (f, d) in want.items():
            if i != f:
                rad[f] = max(rad.get(f, 0.0), d)
        clients = [(i, f) for i, (f, _) in want.items() if i != f]
        count = lambda f, r: sum(g != f and far[i, f] < r and far[i, f] <= reach for i, g in clients)  # noqa: B023, E731
        over = {f: count(f, rad.get(f, 0.0)) for f, (g, _) in want.items() if f == g}
        assert {r.fid: r.over for r in stats.overlap(points, assigned, reach).collect()} == over
        assert {r.fid: r.over for r in stats.overlap_all(points, assigned).collect()} == over

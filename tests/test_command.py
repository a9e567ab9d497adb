import glob

import numpy as np
import pytest

from cloudspark.__main__ import main
from cloudspark.operators import facility


def lines(path):
    return [x.rstrip("\n") for part in sorted(glob.glob(f"{path}/part-*")) for x in open(part)]


def test_cluster_and_export(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(c, 0.02, (20, 3)) for c in (0, 1)])
    (tmp_path / "cloud.txt").write_text("".join(f"{x:.6f} {y:.6f} {z:.6f}\n" for x, y, z in rows))
    main(["cluster", f"{tmp_path}/cloud.txt", f"{tmp_path}/out", "+norm=l2", "+lam=0.3", "+bin=0.3", "+fc=0.5", "+ns=20", "+knn=5", "-s", "-e"], spark)
    assert len(lines(tmp_path / "out/points")) == 40
    owners = [int(x) for x in lines(tmp_path / "out/client_map")]
    assert len(owners) == 40 and all(owners[f] == f for f in owners)
    facilities = lines(tmp_path / "out/facilities")
    assert len(facilities) == len(set(owners))
    table = [x.split() for x in lines(tmp_path / "out/statistics")]
    assert all(len(r) == 16 for r in table) and sum(int(r[8]) for r in table) + len(table) == 40
    assert lines(tmp_path / "out/clusters.dxf").count("POINT") == 80
    assert [x.rsplit("=", 1)[1] for x in lines(tmp_path / "out/tiles.list")] == ["tile_2_1_1", "tile_1_1_1"]
    with pytest.raises(Exception, match="(?i)exist"):
        main(["cluster", f"{tmp_path}/cloud.txt", f"{tmp_path}/out", "+norm=l2", "+knn=5"], spark)

    (tmp_path / "clusters.txt").write_text("# two\n0:\n1 2\n3\n\n20:\n21 99\n")
    (tmp_path / "centroids.txt").write_text("x 0\nx 20\nx\n")
    main(["export", "--points", f"{tmp_path}/cloud.txt", "--clusters", f"{tmp_path}/clusters.txt", "--centroids", f"{tmp_path}/centroids.txt", "--column", "1", "--out", f"{tmp_path}/joined"], spark)
    assert [int(x.split("\t")[0]) for x in lines(tmp_path / "joined")] == [0, 1, 2, 3, 20, 21]


def test_drawing_in_parts(spark, tmp_path):
    from cloudspark.operators import stats
    from cloudspark.sources import dxf, sinks

    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.random(6))) for i in range(50)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, na double, nb double, nc double")
    own = spark.createDataFrame([(i, i - i % 10) for i in range(50)], "id long, fid long")
    entities = dxf.cluster_entities(points, own, stats.bounding_boxes(points, own))
    sinks.write(dxf.drawing_lines(entities), f"{tmp_path}/parts", 4)
    parts = lines(tmp_path / "parts")
    assert len(glob.glob(f"{tmp_path}/parts/part-*")) == 4
    head = (dxf.header() + dxf.tables() + "0\nSECTION\n2\nENTITIES\n").splitlines()
    assert parts[: len(head)] == head and parts[-4:] == ["0", "ENDSEC", "0", "EOF"]
    body = [x for r in dxf.entity_text(entities).collect() for x in r.value.split("\n")]
    assert sorted(parts[len(head) : -4]) == sorted(body)
    # 50 points and 5 facilities with clients: twice the points, a number each, normals, links and 12 edges a box
    assert [body.count(x) for x in ("POINT", "TEXT", "LINE")] == [100, 50, 50 + 45 + 60]


def test_unknown_setting(spark):
    with pytest.raises(SystemExit):
        main(["cluster", "a", "b", "+nothing=1"], spark)


def test_flat_scan_equals_cells_within_reach():
    rng = np.random.default_rng(4)
    data = {c: rng.random(150) for c in "xyz"} | {"fc": np.full(150, 0.3)}
    of = lambda mode: facility.Fold(facility.Params(norm="l2", lam=0.1, bin=0.1, candidate_mode=mode, reach=3.0, open_end=True), data)
    flat, cells = of("flat"), of("radius")
    flat.run(), cells.run()
    assert flat.cost == pytest.approx(cells.cost)


def test_penalty_of_older_revisions():
    a = {"x": 0.0, "y": 0.0, "z": 0.0, "na": 0.0, "nb": 0.0, "nc": 1.0}
    p = facility.Params(norm="abn", lam=0.5, mju=0.9, power=2.0, constant_penalty=True)
    assert facility.distances(p, a, a | {"x": 1.0}) == pytest.approx(0.1 + 0.9 * 2.0)


def test_stream_of_tiles_equals_one_fold(spark, tmp_path):
    from cloudspark.streaming.tile_fold import cluster_stream

    rng = np.random.default_rng(5)
    params = facility.Params(norm="l2", fc=0.2, lam=0.5, bin=0.5)
    rows = [(f"t{i % 2}", 15, i, i + (1 << 60), *map(float, rng.random(3)), 0.2) for i in range(30)]
    names = "tile_id string, tile_size long, pos long, id long, x double, y double, z double, fc double"
    for k in range(3):  # tiles arrive in pieces
        spark.createDataFrame(rows[k::3], names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = cluster_stream(stream, params).writeStream.format("memory").queryName("tiles").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.tile_id, r.id, r.fid) for r in spark.table("tiles").collect()}
    want = {(r.tile_id, r.id, r.fid) for r in facility.cluster(spark.createDataFrame(rows, names), params).collect()}
    assert got == want and len(got) == 30


def test_tiles_by_name(spark, tmp_path):
    """Named tiles alone are opened if rows have ids, and numbered like all tiles if they have none."""
    from cloudspark.sources import points

    texts = {"a": "1 2 3\n4 5 6\n", "b": "7 8 9\nx y z\n", "c": "10 11 12\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "all.list").write_text("c\na\nb\n")
    rows = lambda frame: {(r.id, r.x, r.tile_id) for r in frame.collect()}
    whole = {(0, 10.0, "c"), (1, 1.0, "a"), (2, 4.0, "a"), (3, 7.0, "b")}
    assert rows(points.read_tiles(spark, f"{tmp_path}/all.list")) == whole
    assert rows(points.read_tiles(spark, f"{tmp_path}/all.list", only=["b", "c"])) == {r for r in whole if r[2] != "a"}
    (tmp_path / "b").write_text("70 7 8 9 1 0 0 0\n1 2 3\n")
    found = points.read_tiles(spark, f"{tmp_path}/all.list", only=["b"], own_ids=True)
    assert rows(found) == {(70, 7.0, "b")} and [x.rsplit("/", 1)[1] for x in found.inputFiles()] == ["b"]
    for wrong in (["d"], []):
        with pytest.raises(ValueError):
            points.read_tiles(spark, f"{tmp_path}/all.list", only=wrong)

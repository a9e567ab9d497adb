"""Folds of points that come one batch after the other."""

import time

import numpy as np
import pytest

from cloudspark.operators import facility
from cloudspark.streaming import point_fold

NAMES = "tile_id string, tile_size long, pos long, id long, x double, y double, z double, fc double"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, point_fold.STORE)
    yield
    spark.conf.set(key, before)


def points(n, size):
    rng = np.random.default_rng(21)
    # negative places, ids beyond what a double holds, costs that let later points take clients over
    return [(f"t{i % 2}", size, i, i + (1 << 60), *map(float, rng.normal(0, 0.4, 3)), 0.05 + 0.1 * (i % 4)) for i in range(n)]


def test_points_in_batches_equal_one_fold(spark, tmp_path):
    params = facility.Params(norm="l2", lam=0.3, bin=0.3, candidate_mode="radius")
    rows = points(120, 60)
    batches = [spark.createDataFrame(rows[i : i + 30], NAMES) for i in range(0, 120, 30)]
    got = {(r.tile_id, r.id, r.fid) for r in point_fold.cluster_in_batches(batches, params, f"{tmp_path}/run").collect()}
    want = {(r.tile_id, r.id, r.fid) for r in facility.cluster(spark.createDataFrame(rows, NAMES), params).collect()}
    assert got == want and len(got) == 120 and len({f for *_, f in got}) < 120


def test_a_tile_that_never_fills_ends(spark, store, tmp_path):
    params = facility.Params(norm="l2", lam=0.3, bin=0.3, candidate_mode="flat")
    rows = [(t, None, *rest) for t, _, *rest in points(20, 0)] + [(None, 1, 0, 5, 0.0, 0.0, 0.0, 1.0), ("t9", 1, 0, 6, None, 0.0, 0.0, 1.0)]
    spark.createDataFrame(rows, NAMES).write.parquet(f"{tmp_path}/in")
    stream = point_fold.cluster_points(spark.readStream.schema(NAMES).parquet(f"{tmp_path}/in"), params, idle_ms=500)
    query = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    end = time.time() + 90
    while time.time() < end and spark.table("idle").count() < 20:
        time.sleep(1)
    query.stop()
    got = {(r.tile_id, r.id, r.fid) for r in spark.table("idle").collect()}
    frame = spark.createDataFrame(rows[:20], NAMES)
    assert got == {(r.tile_id, r.id, r.fid) for r in facility.cluster(frame, params).collect()}


def test_a_batch_reads_only_the_cells_around_it():
    """State that is read and written follows the batch, not the tile."""

    class Cells(dict):
        read = wrote = 0

        def getValue(self, key):  # noqa: N802
            self.read += key in self
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self.wrote += 1
            self[key] = value

        removeKey = dict.pop  # noqa: N815

    params = facility.Params(norm="l2", lam=0.1, candidate_mode="radius")
    rng = np.random.default_rng(22)
    for n in (500, 5000):
        cells, at = Cells(), rng.uniform(0, n ** (1 / 3) / 5, (n, 3))
        data = lambda rows: {**dict(zip("xyz", rows.T)), "fc": np.full(len(rows), 0.3)}
        point_fold.StateFold(params, np.arange(n), data(at), cells).fold()
        assert sorted(i for held in cells.values() for i in held[0]) == list(range(n))
        cells.read = cells.wrote = 0
        point_fold.StateFold(params, np.array([n]), data(at[:1] + 0.01), cells).fold()
        assert cells.read <= 27 and 1 <= cells.wrote <= 27
    with pytest.raises(ValueError, match="extent"):
        point_fold.StateFold(facility.Params(candidate_mode="grid"), np.arange(1), data(at[:1]), cells)
